"""Token ids of whole texts, which the core library counts with too."""

from millrace.functions.tokens import *  # noqa: F401,F403
from millrace.functions.tokens import _lowered, _packed, _Words  # noqa: F401
