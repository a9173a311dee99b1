"""spark-submit launcher for one registered query (see pulsegrid.plans.run)."""

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))  # repo root, when not zipped

from pulsegrid.plans.run import main  # noqa: E402

if __name__ == "__main__":
    main()
