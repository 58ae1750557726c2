"""siltgate: sensitive-content scanning and leak analytics on Spark DataFrames."""

__all__ = ["Channel", "Engine", "InjectionPoint", "Layer", "ScanConfig", "Verdict"]
__version__ = "0.2.0"


def __getattr__(name: str):
    """The public names, loaded when they are asked for: Python workers import this package for far less."""
    if name not in __all__:
        raise AttributeError(name)
    from siltgate import config, engine

    return getattr(config if hasattr(config, name) else engine, name)
