"""All registered queries."""

from . import signals, pit, news, model, decisions, audit, backtest, hawkes, storage, checks  # noqa: F401
from .base import REGISTRY  # noqa: F401
