"""Workers that have neither the package on their path nor its folder as their working folder."""

import os
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parents[2]
SCRIPT = """
import sys
sys.path.insert(0, {repo!r})
import corpus_pipeline
from scholium.llm import queries
from scholium.session import get_session

spark = get_session("4", 4)
probe = spark.range(1).mapInPandas(lambda it: (b.assign(id=int(__import__("importlib.util").util.find_spec("scholium") is not None)) for b in it), "id long")
assert probe.first()[0] == 0, "the workers must not find the package"
for name, q in queries.QUERIES.items():
    print(name, q(spark, {sf!r}).count())
print("pipeline", corpus_pipeline.run(spark, {sf!r}).count())
"""


def test_queries_without_the_package_on_workers(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"PYSPARK_PYTHON": sys.executable}
    script = SCRIPT.format(repo=str(REPO), sf="/root/testdata/sf0.001")
    done = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900)
    assert done.returncode == 0, done.stderr[-3000:]
    assert done.stdout.count("op") >= 10 and "pipeline" in done.stdout
