"""``python -m weightscope``."""

import sys

from weightscope.cli import main

sys.exit(main())
