import sys

from quillgraph.cli import main

sys.exit(main())
