"""Operators for preparing training data; nothing else in the library imports this subpackage."""

import sys

from keyloom.session import ship_with_tasks

ship_with_tasks(sys.modules[__name__])
