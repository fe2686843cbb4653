import sys

from quillscan.cli import main

sys.exit(main())
