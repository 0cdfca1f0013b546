import hashlib
import os
import re
import subprocess
import sys

import public_tokenizers
import sentencepiece
from llm_helpers import SF, docs, local  # noqa: F401
from test_decontaminate_and_warc import brute
from test_exact_and_near import brute_exact, brute_near, near_family

import corpus_pipeline
from flipside.llm import queries


def test_pipeline_against_brute_force(spark, docs):
    import pandas as pd

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "near_dedup", "decontamination", "sentencepiece"]
    got = local(corpus_pipeline.run(spark, SF)).set_index("doc_id")
    kept = {r.doc_id for r in queries.op1_quality(spark, SF).where("kept").collect()}
    rows = [(i, t) for i, t in zip(docs.doc_id, docs.text) if i in kept]
    groups = brute_exact(rows)
    rows = [(i, t) for i, t in rows if groups[re.sub(r"[\x20\x09-\x0D]", "", t)][0][1][1] == i]
    component, _ = brute_near(rows, 80)
    rows = [(i, t) for i, t in rows if component[i] == i]
    items = pd.read_parquet(f"{SF}/benchmark.parquet")
    clean = {int(i) for i, n, h, _ in brute(rows, zip(items.item_id, items.text)) if not (h and 20 * h >= n)}
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = {i: hashlib.sha256(",".join(map(str, library.encode(t))).encode()).hexdigest() for i, t in rows if i in clean}
    assert got.ids_sha256.to_dict() == want and 0 < len(want) < len(docs)


def test_stages_keep_the_columns(spark):
    frame = corpus_pipeline.documents(spark, SF)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, frame, SF).schema.names == frame.schema.names


def test_stages_pass_odd_rows(spark, tmp_path):
    import odd

    frame = odd.table(spark)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, frame, SF).count() > 0
        assert stage(spark, odd.empty(spark), SF).count() == 0


def test_near_stage_links_from_80(spark):
    """A 200-word text with four scattered words changed shares 176 of 216 shingles: 0.815."""
    import odd

    base = [f"{w}{k}" for k, w in enumerate(odd.words(20, 200).split())]
    edited = ["new" if k in (30, 70, 110, 150) else w for k, w in enumerate(base)]
    rows = [(2, " ".join(base)), (1, " ".join(edited))] + near_family(21, 200, 20, 4, 100) + near_family(22, 150, 20, 3, 200)
    component, _ = brute_near(rows, 80)
    assert component != brute_near(rows)[0]
    stage = dict(corpus_pipeline.STAGES)["near_dedup"]
    got = stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(i for i, _ in rows if component[i] == i)


def test_near_stage_on_the_table(spark, docs):
    component, _ = brute_near(list(zip(docs.doc_id, docs.text)), 80)
    got = dict(corpus_pipeline.STAGES)["near_dedup"](spark, corpus_pipeline.documents(spark, SF), SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(i for i in component if component[i] == i)


def test_stages_keep_rows_and_not_ids(spark):
    """Repeated and null ids: each row stands for itself."""
    import odd
    import pandas as pd

    base, other, item = odd.words(31, 300), odd.words(32, 300), pd.read_parquet(f"{SF}/benchmark.parquet").text.iloc[0]
    near_base = base + " tail"
    rows = [(5, base), (5, base), (None, base), (4, base + " "), (4, other), (None, other), (None, other), (None, item), (None, None), (6, item), (6, near_base), (3, near_base)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    stages = dict(corpus_pipeline.STAGES)
    kept = lambda name: sorted(map(tuple, stages[name](spark, frame, SF).collect()), key=str)
    assert kept("exact_dedup") == sorted([(4, base + " "), (4, other), (None, None), (6, item), (3, near_base)], key=str)
    assert kept("near_dedup") == sorted([(3, near_base), (4, other), (None, None), (6, item)], key=str)
    assert kept("decontamination") == sorted([r for r in rows if r[1] != item], key=str)


def test_stages_keep_rows_of_stored_tables(spark, tmp_path):
    """Numbers from files and places in them: unique, the same at each reading, and none lost."""
    import odd

    base = odd.words(33, 300)
    frame = spark.createDataFrame([(1, base), (1, base), (None, base), (None, "lone words"), (2, "")] * 8, "doc_id long, text string")
    frame.repartition(5).write.parquet(f"{tmp_path}/some files")
    table = spark.read.parquet(f"{tmp_path}/some files")
    rows, row = corpus_pipeline.numbered(table)
    first, again = (sorted(map(tuple, rows.select(row, "doc_id", *more).collect()), key=str) for more in ([], []))
    assert first == again and len({r[0] for r in first}) == 40 and rows.columns == ["doc_id", "text", row]
    stages = dict(corpus_pipeline.STAGES)
    kept = lambda name: sorted(map(tuple, stages[name](spark, table, SF).collect()), key=str)
    assert kept("exact_dedup") == sorted([(1, base), (None, "lone words"), (2, "")], key=str)
    assert kept("near_dedup") == sorted([(1, base), (None, "lone words")] + [(2, "")] * 8, key=str)
    assert len(kept("decontamination")) == 40


def test_the_rest_stands_without_the_subpackage(tmp_path):
    """The entry module imports, and offers the other queries, where the subpackage and the pipeline are gone."""
    root = os.path.dirname(os.path.abspath(corpus_pipeline.__file__))
    for name in os.listdir(root):
        if name not in ("flipside", "corpus_pipeline.py", ".git"):
            os.symlink(f"{root}/{name}", tmp_path / name)
    os.mkdir(tmp_path / "flipside")
    for name in os.listdir(f"{root}/flipside"):
        if name != "llm":
            os.symlink(f"{root}/flipside/{name}", tmp_path / "flipside" / name)
    code = f"import sys; sys.path.insert(0, {str(tmp_path)!r}); import importlib.util as u; s = u.spec_from_file_location('e', {str(tmp_path)!r} + '/__spark_entry__.py'); "
    code += "m = u.module_from_spec(s); sys.path = [p for p in sys.path if p not in ('', " + repr(root) + ")]; "
    code += "exec(open(s.origin).read().replace('os.path.dirname(os.path.abspath(__file__))', repr(" + repr(str(tmp_path)) + ")), m.__dict__); q = m.queries(); print(len(q), any(k.startswith('op') for k in q))"
    said = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=tmp_path, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    assert said.returncode == 0 and said.stdout.split()[1] == "False" and int(said.stdout.split()[0]) > 30, said.stderr[-2000:]


def test_last_stage_remembers_fewer_segments(monkeypatch):
    """The pipeline bounds the segments that its encoder keeps below the operator's own bound."""
    import inspect

    import corpus_pipeline
    from flipside.llm import pieces_codec
    seen = []
    monkeypatch.setattr(pieces_codec, "round_trip", lambda docs, path, memo: seen.append(memo))
    corpus_pipeline.encoded(None, None, "")
    assert seen[0] < inspect.signature(pieces_codec.encode).parameters["memo"].default
