"""spark-submit launcher for the end-to-end job.

spark-submit --py-files ledgerlake.zip scripts/run_pipeline.py in1.csv in2.csv --merge --output out/
(locally: python scripts/run_pipeline.py ... or python -m ledgerlake.plans.pipeline ...)
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from ledgerlake.plans.pipeline import main  # noqa: E402

if __name__ == "__main__":
    main()
