import base64
import gzip
import hashlib
import io
import re

import odd
from llm_helpers import SF, docs, local  # noqa: F401

from flipside.llm import decontaminate, queries, warc


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, width=13):
    windows = []
    for i, t in items:
        w = words(t)
        n = min(width, len(w))
        windows += [(str(i), w[k:k + n]) for k in range(len(w) - n + 1) if n]
    out = []
    for i, t in docs:
        w, hit, which = words(t), set(), set()
        for item, g in windows:
            for k in range(len(w) - len(g) + 1):
                if w[k:k + len(g)] == g:
                    hit.update(range(k, k + len(g)))
                    which.add(item)
        out.append((str(i), len(w), len(hit), sorted(which)))
    return sorted(out)


def test_hits_against_brute_force(spark):
    base = odd.words(1, 300)
    items = [(1, " ".join(base.split()[20:60])), (2, "one two THREE"), (3, None), (4, ""), (5, "..."), (6, odd.words(9, 30)),
             (7, "épsilon-12"), (None, base), (7, " ".join(base.split()[100:112])), (8, "kappa1"), (9, "漢字かな交じり文")]
    table = spark.createDataFrame(items, "item_id int, text string")
    want = brute([r[:2] for r in odd.rows()], [i for i in items if i[0] is not None])
    for block_words in (2_000_000, 40, 1):
        got = local(decontaminate.find_hits(odd.table(spark), table, block_words=block_words))
        assert sorted((str(None if r.doc_id is None else int(r.doc_id)), r.n_words, r.n_hit, r.items) for r in got.itertuples()) == want
        assert all(sum(s.end - s.start for s in r.spans) == r.n_hit for r in got.itertuples())


def test_hits_of_empty_tables(spark):
    items = spark.createDataFrame([], "item_id int, text string")
    assert local(decontaminate.find_hits(odd.table(spark), items)).n_hit.sum() == 0
    assert local(decontaminate.find_hits(odd.empty(spark), items)).empty


def test_decontamination_query(spark, docs):
    import pandas as pd

    items = pd.read_parquet(f"{SF}/benchmark.parquet")
    got = local(queries.op3_decontamination(spark, SF))
    want = brute(zip(docs.doc_id, docs.text), zip(items.item_id, items.text))
    assert sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got.itertuples()) == [
        (i, n, h, len(x), hashlib.sha256(",".join(x).encode()).hexdigest(), h > 0 and 20 * h >= n) for i, n, h, x in want]


PAGES = [(1, "http://a", "same"), (2, None, "same"), (3, "http://c\nd", "same"), (4, "u", None), (5, "u", ""), (6, "u", "é" * 50_000),
         (7, "u", "\r\n\r\nContent-Length: 5\r\n"), (None, "u", "no id"), (8, "u", "other"), (8, "u", "other"), (9, "u", odd.words(3, 9000))]


def test_warc_round_trip(spark):
    table = spark.createDataFrame([(*p, "x", 3) for p in PAGES], "page_id long, url string, html string, payload string, id int")
    last = {}
    for i, _, h in PAGES:
        last[h or ""] = max(last.get(h or "", -1), -1 if i is None else i)
    want = sorted((str(i), len((h or "").encode()), base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode(),
                   "response" if i in (None, last[h or ""]) else "revisit", None if i in (None, last[h or ""]) else last[h or ""]) for i, _, h in PAGES)
    folder, manifest = warc.write_warc(table)
    for split in (4 << 20, 300, 37):
        got = local(warc.read_warc(manifest, folder, split=split))
        number = lambda x: None if x is None or x != x else int(x)
        assert sorted((str(number(r.page_id)), r.payload_bytes, r.payload_digest, r.record_type, number(r.refers_to)) for r in got.itertuples()) == want
    folder, manifest = warc.write_warc(table, least=5)
    small = local(warc.read_warc(manifest, folder)).query("payload_bytes < 5")
    assert (small.record_type == "response").all() and len(small) == 5
    assert bytes(got[got.page_id == 6].payload.iloc[0]).decode() == "é" * 50_000


def test_warc_empty_table(spark):
    folder, manifest = warc.write_warc(spark.createDataFrame([], "page_id long, url string, html string"))
    assert local(warc.read_warc(manifest, folder)).empty


def test_false_members_are_passed_over():
    one, two = warc.record(1, None, b"x", None, "2000"), warc.record(2, None, b"y", None, "2000")
    junk = gzip.compress(b"no header") + warc.MAGIC + b"junk" + warc.MAGIC
    data = junk + one + junk + two + one[:-9]
    found = [warc.parse(c)["page_id"] for _, c in warc.members(io.BytesIO(data), 0, len(data))]
    assert found == [1, 2]
    for cut in range(0, len(data), 11):
        parts = [warc.parse(c)["page_id"] for a, b in ((0, cut), (cut, len(data))) for _, c in warc.members(io.BytesIO(data), a, b)]
        assert parts == [1, 2]


def test_warc_query(spark):
    import pandas as pd

    pages = pd.read_parquet(f"{SF}/pages.parquet")
    got = local(queries.op10_warc(spark, SF)).set_index("page_id")
    assert len(got) == len(pages)
    for r in pages.itertuples():
        assert got.payload_digest[r.page_id] == base64.b32encode(hashlib.sha1(r.html.encode()).digest()).decode()
