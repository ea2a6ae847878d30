import sys

from scholion.cli import main

sys.exit(main())
