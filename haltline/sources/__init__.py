"""Reading feeds and keeping published versions."""
