"""Launcher for spark-submit (which runs a script, not a module):

    spark-submit --py-files retentia.zip run_job.py refresh --messages M --conversations C --sessions S

See ``retentia/plans/cli.py`` for the jobs and their options.
"""

import json
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from retentia.plans.cli import run  # noqa: E402

if __name__ == "__main__":
    print(json.dumps(run(sys.argv[1:])))
