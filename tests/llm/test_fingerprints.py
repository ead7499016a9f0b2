import regex
import xxhash
from pyspark.sql import functions as F

from postlens.llm import fingerprints as fp
from tests.conftest import SF
from tests.llm import plain


def _signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


def _hash_longs(*values, seed=42):
    h = seed
    for v in values:
        h = xxhash.xxh64_intdigest(int(v).to_bytes(8, "little", signed=True), seed=h)
    return _signed(h)


def anchors(text):
    """Chosen runs as tuples of their hashed tokens."""
    tokens = regex.findall(r"[\p{L}\p{N}]{1,6}|[^\s\p{L}\p{N}]", text, flags=regex.ASCII if False else 0)
    if not tokens:
        return []
    marks = [0] * (fp.K - 1) + [_signed(xxhash.xxh64_intdigest(t.encode(), seed=42)) for t in tokens] + [0] * (fp.K - 1)
    inner = [_hash_longs(a, b) for a, b in zip(marks, marks[1:])]
    n = fp.K - fp.S + 1
    return [tuple(inner[i : i + n : fp.S]) for i in range(len(inner) - n + 1)
            if min(inner[i], inner[i + n - 1]) == min(inner[i : i + n])]


def expected(rows):
    ordered = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    out = []
    for k, (doc, text) in enumerate(ordered):
        text, after = text or "", ordered[(k + 1) % len(ordered)][1] or ""
        third = len(text) // 3
        edited = text[: len(text) - third] + after[:third]
        a, b, c = (set(anchors(x)) for x in (text, edited, after))
        like = lambda x, y: 1.0 if not x and not y else 2 * len(x & y) / (len(x) + len(y))
        out.append((doc, len(text), plain.sha(edited), len(anchors(text)) * 8, len(anchors(edited)) * 8, round(like(a, b), 9), round(like(a, c), 9)))
    return sorted(out, key=repr)


def result(documents):
    return sorted((
        (r["doc_id"], r["n_chars"], r["edited_sha256"], len(r["fingerprint"]), len(r["edited_fingerprint"]),
         round(r["near_edited"], 9), round(r["near_next"], 9)) for r in fp.fingerprint_documents(documents).collect()), key=repr)


def test_equals_brute_force(spark):
    documents = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    assert result(documents) == expected([tuple(r) for r in documents.collect()])


def test_odd_rows(spark):
    rows = [(5, "one two three four"), (None, None), (5, ""), (5, ""), (-3, "!"), (2, "日本語 𝒳𝒳𝒳 text"), (1 << 62, "a"), (9, "long " * 4000)]
    documents = spark.createDataFrame(rows, "doc_id long, text string").withColumn("anchors", F.lit("x"))
    assert result(documents) == expected(rows)
    assert fp.fingerprint_documents(documents.limit(0)).count() == 0
    alone = fp.fingerprint_documents(documents.where("doc_id = 2")).first()
    assert alone["near_next"] == 1.0


def test_equal_texts_have_equal_fingerprints(spark):
    rows = fp.fingerprint_documents(spark.createDataFrame([(i, "same text here") for i in range(5)], "doc_id long, text string")).collect()
    assert len({r["fingerprint"] for r in rows}) == 1 and rows[0]["fingerprint"]
