"""Operators on frames that this package did not read, from another folder."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

JOB = """
import sys
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false")
         .config("spark.sql.shuffle.partitions", "2").config("spark.checkpoint.dir", sys.argv[1]).getOrCreate())
docs = spark.createDataFrame([(k, f"some words of text {k} " * 30, "en", "s") for k in range(30)], "doc_id long, text string, lang string, source string")
embeddings = spark.createDataFrame([(k, [float(k % 5), 1.0, 2.0], k % 2) for k in range(12)], "vec_id long, embedding array<float>, label int")
talks = spark.createDataFrame([(1, 0, "user", "Hi."), (1, 1, "assistant", "Yes.")], "conv_id long, turn long, role string, text string")
sys.path.insert(0, ROOT)
from pyspark.sql import functions as F
if CASE == 0:
    from ratecraft.llm import quality
    print(quality.judge(docs).count())
elif CASE == 1:
    from ratecraft.llm import pseudo_lm
    print(pseudo_lm.pseudo_likelihood(docs).count())
elif CASE == 2:
    from ratecraft.llm import binary
    print(binary.read_back(binary.write(docs)).count())
elif CASE == 3:
    from ratecraft.llm import embed_dedup, hard_negatives
    print(embed_dedup.near_duplicates(embeddings).count() + 0 * hard_negatives.mine(embeddings, F.col("vec_id") % 4 == 0).count())
elif CASE == 4:
    from ratecraft.llm import conversations, token_counts
    print(conversations.repair(talks).count() + token_counts.token_counts(docs).count())
"""


def test_operators_reach_workers_that_cannot_see_the_package(tmp_path):
    wanted = {0: 30, 1: 30, 2: 30, 3: 12, 4: 31}
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    running = {}
    for case in wanted:
        job = tmp_path / f"job{case}.py"
        job.write_text(f"ROOT, CASE = {ROOT!r}, {case}\n{JOB}")
        folder = tmp_path / f"at{case}"
        folder.mkdir()
        running[case] = subprocess.Popen([sys.executable, str(job), str(tmp_path / f"shared{case}")], cwd=folder, env=env, text=True,
                                         stdout=subprocess.PIPE, stderr=subprocess.PIPE)
    for case, p in running.items():
        out, err = p.communicate(timeout=300)
        assert p.returncode == 0, err[-3000:]
        assert out.split()[-1] == str(wanted[case])
