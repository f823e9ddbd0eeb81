from . import codes, formats  # noqa: F401  (registers all formats)
