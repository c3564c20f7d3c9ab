"""Rule files: fixed values, see ``rules.yaml`` and ``fallback.yaml``."""
