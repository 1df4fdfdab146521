class EngineError(ValueError):
    """Raised while a plan is built: unknown column, bad unit, bad schema text, wrong width."""
