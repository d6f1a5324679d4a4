from panelrisk.functions import calendar, scalars, text  # noqa: F401
