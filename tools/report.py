"""Launcher for ``spark-submit`` (which runs files, not modules): same arguments as
``python -m lanescope``."""

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from lanescope.__main__ import main  # noqa: E402

if __name__ == "__main__":
    sys.exit(main())
