import os
import subprocess
import sys

SCRIPT = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
from pyspark.sql import functions as F

def imported(batches):
    for batch in batches:
        try:
            import cohortspark
            raise AssertionError("the workers can import the package")
        except ModuleNotFoundError:
            yield batch

spark.range(1).mapInPandas(imported, "id long").collect()
import corpus_pipeline
from cohortspark.llm import queries
for name in ("op6_decontamination", "op7_language", "op11_byte_bpe"):
    print(name, queries.QUERIES[name](spark, {sf!r}).count())
docs = spark.read.parquet({sf!r} + "/documents.parquet")
for name, stage in corpus_pipeline.STAGES:
    docs = stage(spark, docs, {sf!r})
print("pipeline", docs.count())
"""


def test_workers_need_no_copy_of_the_package(sf_dir, tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    script = tmp_path / "run.py"
    script.write_text(SCRIPT.format(root=root, sf=sf_dir))
    done = subprocess.run([sys.executable, str(script)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr[-3000:]
    counts = dict(line.split() for line in done.stdout.splitlines() if line.startswith(("op", "pipeline")))
    assert len(counts) == 4 and all(int(n) > 0 for n in counts.values())
