"""What the engine raises on the driver when a contract is broken."""


class ConfigError(ValueError):
    """A configuration has unknown, missing or badly typed fields."""


class ProtocolError(ValueError):
    """A worker request or result breaks the exchange contract."""


class FreezeError(RuntimeError):
    """Frozen content is not what it was."""


class LedgerError(RuntimeError):
    """A job ledger was asked for something its state does not allow."""
