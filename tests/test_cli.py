import json

import numpy as np

from prosodia import catalog, catalog_learning, catalog_records, cli  # noqa: F401  the query modules fill the catalog
from prosodia.sources import files
from tests.test_functions import bursts
from tests.test_sources_plans import record


def test_jobs(spark, tmp_path):
    d = str(tmp_path)
    for sub in ("audio", "texts", "analyses", "words", "hyp"):
        (tmp_path / sub).mkdir()
    (tmp_path / "audio/r.wav").write_bytes(files.encode_wave(np.asarray(bursts())))
    (tmp_path / "texts/r.txt").write_text("ма мама\n")
    (tmp_path / "analyses/r_syllable_analysis.json").write_text(json.dumps(record()))
    (tmp_path / "words/w.json").write_text("\n".join(json.dumps({"recording_id": "r", "word_idx": i, "word": w, "start": s, "end": e, "conf": 0.9}) for i, (w, s, e) in enumerate([("ма", 0.2, 0.45), ("мама", 0.55, 1.3)])))
    (tmp_path / "hyp/h.json").write_text(json.dumps({"recording_id": "r", "engine": "e", "text": "ма"}))
    (tmp_path / "s.json").write_text(json.dumps({"best": {"overrides": {"weak_min_confidence": 0.9, "unknown": 1}}}))
    run = lambda *a: (lambda p: p.job(spark, p))(cli.parser().parse_args(list(a)))
    run("analyse", "--audio", f"{d}/audio", "--words", f"{d}/words", "--texts", f"{d}/texts", "--out", f"{d}/a")
    assert spark.read.parquet(f"{d}/a/words").count() == 2 and spark.read.parquet(f"{d}/a/comparison").first().word_accuracy == 1.0
    run("reduce", "--analyses", f"{d}/analyses", "--pool", "r", "--out", f"{d}/red")
    assert spark.read.json(f"{d}/red/comparison").count() == 2
    run("stress", "--analyses", f"{d}/analyses", "--out", f"{d}/st")
    run("recognisers", "--texts", f"{d}/texts", "--hypotheses", f"{d}/hyp", "--out", f"{d}/w")
    assert spark.read.json(f"{d}/w/aggregate").first().wer == 50.0
    run("detect", "--audio", f"{d}/audio", "--settings", f"{d}/s.json", "--out", f"{d}/n")
    assert spark.read.json(f"{d}/n").count() == 3
    words = spark.createDataFrame([("Мамы",), ("x",)], "word string")
    lemmas = spark.createDataFrame([("мамы", "мама", "NOUN", 0), ("мамы", "мам", "NOUN", 1)], "word string, lemma string, pos string, rank int")
    assert {r.word: r.lemma for r in cli.with_lemmas(words, lemmas).collect()} == {"Мамы": "мама", "x": None}


def test_entry_without_corpus_operators(tmp_path):
    """A copy of the repository without the corpus folders still imports and registers the rest."""
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(root, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", ".pytest_cache", "spark-warehouse"))
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q) and not any(k.startswith('op') for k in q); print(len(q))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", capture_output=True, text=True, timeout=120)
    assert done.stdout.strip() == str(len(catalog.QUERIES)), done.stderr
