"""ledgerloom: reconciling a purchase ledger with supplier invoices as Spark DataFrame plans."""

from ledgerloom.config import Config

__all__ = ["Config"]
