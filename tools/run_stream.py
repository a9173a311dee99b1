"""spark-submit launcher for the reading stream (see pulsegrid.streaming.jobs)."""

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))  # repo root, when not zipped

from pulsegrid.streaming.jobs import main  # noqa: E402

if __name__ == "__main__":
    main()
