import sys

from strandmap.cli import main

sys.exit(main())
