import os
import shutil
import subprocess
import sys
from collections import Counter

import corpus_pipeline as P
from sigspark.llm import decontam, mixing, quality
from sigspark.llm.common import table
from tests.llm.brute import jaccard_components
from tests.llm.test_decontam import brute

SF = "/root/testdata/sf0.001"


def test_every_stage_decides_on_all_that_came_before(spark, tmp_path):
    docs = table(spark, SF, "documents")
    columns, kept = docs.columns, [docs]
    for i, (name, stage) in enumerate(P.STAGES):
        stage(spark, kept[-1], SF).write.parquet(f"{tmp_path}/{i}")
        kept.append(spark.read.parquet(f"{tmp_path}/{i}"))
    assert all(d.columns == columns for d in kept[:-1])
    rows = [d.collect() for d in kept]
    ids = [[r.doc_id for r in x] for x in rows]
    # quality
    good = {r.doc_id for r in quality.score(docs, table(spark, SF, "labels")).where("predicted = 1").collect()}
    assert set(ids[1]) == good and len(good) < len(ids[0])
    # near duplicates: the smallest id of each component of what was left
    comp = jaccard_components([(r.doc_id, r.text) for r in rows[1]])
    assert sorted(ids[2]) == sorted({c for _, c in comp.values()}) and len(ids[2]) < len(ids[1])
    # decontamination
    items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    bad = {d for d, n, h, _ in brute([(r.doc_id, r.text) for r in rows[2]], items) if h and 20 * h >= n}
    assert set(ids[3]) == set(ids[2]) - bad and bad
    # mix: every row as often as its copies say
    copies = {r.doc_id: r.copies for r in mixing.mix(kept[3]).collect()}
    assert Counter(ids[4]) == Counter({d: c for d, c in copies.items() if c})
    # tokens: a row per copy, in order of ids
    assert [r.doc_id for r in sorted(rows[5], key=lambda r: r.start)] == sorted(ids[4])
    assert decontam.occurrences(kept[4], table(spark, SF, "benchmark")).where("n_hit > 0 and 20 * n_hit >= n_words").count() == 0


def test_run_equals_the_stages(spark):
    got = P.run(spark, SF).collect()
    assert got and {"doc_id", "start", "n_tokens", "ids_crc32"} == set(got[0].asDict())


def test_entry_without_the_subpackage(tmp_path):
    root = os.path.dirname(os.path.abspath(P.__file__))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    shutil.copytree(f"{root}/sigspark", tmp_path / "sigspark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); print(len(q) > 150, 'pipeline' in q, any(n[:2] == 'op' and n[2].isdigit() for n in q), len(e.oracle_sql()) > 150)"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120, env=env)
    assert out.stdout.split() == ["True", "False", "False", "True"], out.stderr
