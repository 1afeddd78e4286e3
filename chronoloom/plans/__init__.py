"""Views, registered queries and the experiment runner."""
