"""Every operator runs where executors have the public libraries only, not this package."""

import subprocess
import sys
import textwrap
from pathlib import Path

ROOT = Path(__file__).resolve().parents[2]

SCRIPT = """
    import sys
    sys.path.insert(0, {root!r})
    from pyspark.sql import SparkSession, functions as F
    # Workers start in this folder and do not get the driver's path.
    spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
    def foreign(batches):
        for batch in batches:
            try:
                import tallyhouse
                yield batch
            except ModuleNotFoundError:
                pass
    assert spark.range(4).mapInPandas(foreign, "id long").count() == 0
    from __spark_entry__ import queries
    for name, query in queries().items():
        if name.startswith("op") and name[2].isdigit():
            query(spark, {folder!r}).write.format("noop").mode("overwrite").save()
            print("ran", name, flush=True)
"""


def test_executors_need_no_copy_of_the_package(folder, tmp_path):
    script = tmp_path / "run.py"
    script.write_text(textwrap.dedent(SCRIPT.format(root=str(ROOT), folder=folder)))
    ran = subprocess.run([sys.executable, str(script)], cwd=tmp_path, capture_output=True, text=True, timeout=900)
    assert ran.returncode == 0, ran.stderr[-2000:]
    assert ran.stdout.count("ran op") == 13
