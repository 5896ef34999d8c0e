"""Signal views over the given tables, end-to-end plans and the registered queries."""

from importlib import import_module

MODULES = ["q_files", "q_spectra", "q_pulses", "q_measure", "q_decisions", "q_scoring", "q_streams"]


def load():
    """Register every query once and return the registry."""
    for m in MODULES:
        import_module(f"{__name__}.{m}")
    return import_module(f"{__name__}.registry")
