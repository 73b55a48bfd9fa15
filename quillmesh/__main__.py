import sys

from quillmesh.cli import main

sys.exit(main())
