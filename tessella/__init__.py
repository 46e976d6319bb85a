"""Knowledge-graph and corpus analytics as DataFrame transformations."""
