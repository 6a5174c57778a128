"""Column functions and the few Python-side functions."""
