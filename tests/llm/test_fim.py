"""op12 against a plain version, and its parts on odd texts."""

import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewell.llm import fim

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def brute(text, numbers, rate=50, spm_rate=80):
    w = TOKEN.findall(text)
    assert "".join(w) == text
    a, b = sorted(h % (len(w) + 1) for h in numbers[:2])
    pre, mid, suf = "".join(w[:a]), "".join(w[a:b]), "".join(w[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or numbers[2] % 100 >= rate:
        return len(w), "plain", text, None, None
    if numbers[3] % 100 < spm_rate:
        return len(w), "spm", f"<S>{suf}<P>{pre}<M>{mid}", len(pre), len(mid)
    return len(w), "psm", f"<P>{pre}<S>{suf}<M>{mid}", len(pre), len(mid)


def numbers_of(key):
    h = hashlib.sha256(f"42:{'' if key is None else key}".encode()).hexdigest()
    return [int(h[i : i + 8], 16) for i in range(0, 32, 8)]


PIECES = st.sampled_from(["<", "P", "S", ">", "<P>", "<S>", "<M>", "a", "été", "\U0001f600", " ", "\t\n", " ", "\u0085", "word", "\x0b", "\x1c"])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.lists(PIECES, max_size=12).map("".join), st.tuples(*[st.integers(0, 2**32 - 1)] * 4)), min_size=1, max_size=9), st.integers(1, 40))
def test_blocks_are_the_plain_version(rows, span):
    before, fim._SPAN = fim._SPAN, span
    try:
        texts, hashes = [t.encode() for t, _ in rows], np.array([h for _, h in rows], np.int64)
        got = fim.transform_block(texts, hashes, 70, 50)
        outputs = got["output"].to_pylist()
        for i, (t, h) in enumerate(rows):
            n, form, out, pre, mid = brute(t, h, 70, 50)
            assert (got["n"][i], fim.FORMS[got["form"][i]], outputs[i]) == (n, form, out)
            if form != "plain":
                assert got["chars"][i].tolist() == [pre, mid, len(t) - pre - mid]
        assert [x.encode() for x in fim.restore_block([o.encode() for o in outputs], got["form"]).to_pylist()] == texts
    finally:
        fim._SPAN = before


def test_odd_rows(odd_docs):
    got = fim.restore(fim.transform(odd_docs)).collect()
    expected = [(r.doc_id, *brute(r.text or "", numbers_of(r.doc_id)), r.text or "") for r in odd_docs.collect()]
    assert sorted(((r.doc_id, r.n, r.form, r.output, r.prefix_chars, r.middle_chars, r.restored) for r in got), key=repr) == sorted(expected, key=repr)


def test_contract_columns(docs, no_docs):
    for r in fim.contract(docs).join(docs.select("doc_id", "text"), "doc_id").collect():
        n, form, out, pre, mid = brute(r.text or "", numbers_of(r.doc_id))
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output_sha256, r.restored_sha256) == (n, form, pre, mid, sha(out), sha(r.text or ""))
    assert fim.contract(no_docs).collect() == []


def test_long_text_is_moved_in_spans():
    text = b"<P one\xc3\xa9 " * 700_000
    got = fim.transform_block([b"", text, b"x"], np.array([[1, 2, 3, 4], [123457, 999_983, 0, 99], [0, 0, 0, 0]], np.int64))
    assert got["form"].tolist() == [0, 1, 2]
    assert fim.restore_block([o.encode() for o in got["output"].to_pylist()], got["form"]).to_pylist() == ["", text.decode(), "x"]


def test_damaged_outputs_are_errors(spark):
    rows = fim.transform(spark.createDataFrame([(k, f"some words of text {k}") for k in range(20)], "doc_id long, text string"), rate=100)
    for damage in (F.regexp_replace("output", "<M>", ""), F.concat("output", F.lit("<M>")), F.translate("output", "PS", "SP")):
        with pytest.raises(Exception, match="sentinels"):
            fim.restore(rows.withColumn("output", damage)).collect()
    with pytest.raises(ValueError, match="there already"):
        fim.restore(rows, name="n")
