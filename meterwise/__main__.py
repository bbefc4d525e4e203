"""``python -m meterwise ...`` is the command-line front end (see ``meterwise.cli``)."""

import sys

from meterwise.cli import main

sys.exit(main())
