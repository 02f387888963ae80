"""``python -m folioscope``: the evaluation's command line."""

import sys

from .job import main

sys.exit(main())
