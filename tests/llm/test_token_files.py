"""Direct codes and packing against whole-text encoding."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from diffgauge.llm import dac, packing
from diffgauge.llm.units import UnitEncoder, dropped_spaces, leading_spaces
from diffgauge.session import scratch_dir

from llm_rows import odd_rows

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


def whole(path):
    t = Tokenizer.from_file(path)
    return lambda text: np.asarray(t.encode(text or "", add_special_tokens=False).ids, "<u4")


@pytest.mark.parametrize("path,units", [(WORD, dropped_spaces), (BYTE, leading_spaces)])
def test_units_equal_whole_texts(path, units):
    encode, one = UnitEncoder(path, units).encode, whole(path)

    @settings(max_examples=300, deadline=None)
    @given(st.text(st.sampled_from("aB'sé́ \n\t\r\x00\x1c 　1.-|#İſ"), max_size=30) | st.text(max_size=20))
    def check(text):
        assert encode([text])[0] == one(text).tobytes()
    check()
    for _, text, *_ in odd_rows():
        assert encode([text or ""])[0] == one(text).tobytes()


def test_special_strings_are_the_librarys():
    """Ids by the library alone, stated as values; joint learning of many units changes nothing."""
    text = "ab <|endoftext|> cd"
    for path, units, ids in ((WORD, dropped_spaces, [3937, 49407, 4480]), (BYTE, leading_spaces, [397, 220, 50256, 22927])):
        tool, one = UnitEncoder(path, units), whole(path)
        assert np.frombuffer(tool.encode([text])[0], "<u4").tolist() == ids
        texts = [text, "<|endoftext|>", "plain <|endoftext", "x<|startoftext|>y", "<|ENDOFTEXT|>", " ", text * 50] + [
            "word%d <| end of |> text" % i for i in range(900)]
        assert tool.encode(texts) == [one(t).tobytes() for t in texts]


@pytest.mark.parametrize("path,units", [(WORD, dropped_spaces), (BYTE, leading_spaces)])
def test_a_word_is_learned_once(path, units):
    """With a space or marks around it, in one text or in many; before, each of these forms was kept and encoded anew."""
    tool, one = UnitEncoder(path, units), whole(path)
    texts = [f"x {w}{m} {w}{m}\n{w}" for w in ("gelernt", "Übermut", "mot", "ΟΔΟΣ", "각가", "İd", "Åå") for m in ("", ",", "...", "!?", ".&&&")]
    assert tool.encode(texts) == [one(t).tobytes() for t in texts]
    assert not [u for u in tool.known if u.rstrip(",.!?&") not in (u, "") and u.strip(" ,.!?&").isascii()]
    calls = []
    tool._learn = calls.append
    tool.encode(["x mot!? gelernt, gelernt", "x mot... mot,"])
    assert not calls


@pytest.mark.parametrize("path,units", [(WORD, dropped_spaces), (BYTE, leading_spaces)])
def test_any_character_may_be_in_a_text(path, units):
    """No character is kept for cuts; letters of all scripts, alone and between others, are the library's."""
    tool, one = UnitEncoder(path, units), whole(path)
    every = "".join(map(chr, range(32))) + "".join(map(chr, range(0xe000, 0xf900))) + " a\x00 b.\x01\n\ue000, c"
    texts = [every, "plain, text", "", every[::-1]]
    assert tool.encode(texts) == [one(t).tobytes() for t in texts]
    letters = [chr(c) for c in range(0x41, 0x20000) if chr(c).isalpha()]
    texts = [" ".join(f"{c} a{c}b. {c}{c}" for c in letters[at:at + 500]) for at in range(0, len(letters), 500)]
    assert tool.encode(texts) == [one(t).tobytes() for t in texts]


def test_batches_by_the_bytes_of_their_texts():
    import pyarrow as pa
    from diffgauge.llm.common import text_slices
    texts = ["é" * 3, None, "", "abc", "y" * 40, "", "z", None] * 3
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    parts = [b.column("text").to_pylist() for b in text_slices(iter([batch, batch.slice(0, 0), batch.slice(3, 2)]), 16)]
    assert [t for p in parts for t in p] == texts + texts[3:5] and all(parts) and len(parts) > 5
    assert all(sum(len((t or "").encode()) for t in p[1:]) < 16 for p in parts)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2 ** 32 - 1) | st.integers(0, 300), min_size=1, max_size=1500), st.data())
def test_codes_round_trip(ids, data):
    code = dac.Dac.of(np.asarray(ids, "<u4"))
    code = dac.Dac([c.tobytes() for c in code.chunks], [b.tobytes() for b in code.bitmaps],
                   [r.tobytes() for r in code.ranks])
    a = data.draw(st.integers(0, len(ids)))
    b = data.draw(st.integers(a, len(ids)))
    assert code.slice(a, b).tolist() == ids[a:b]
    at = data.draw(st.integers(0, len(ids) - 1))
    assert code.get(at) == ids[at]


def test_store(spark, odd, none):
    path, one = scratch_dir(spark), whole(WORD)
    dac.write_store(odd, path, WORD, dropped_spaces, 2)
    got = sorted(dac.read_documents(spark, path).collect(), key=lambda r: r["start"])
    want = {}
    for doc_id, text, *_ in odd_rows():
        want.setdefault(doc_id, []).append(np.append(one(text), 2).astype("<u4").tobytes())
    assert [-1 if r["doc_id"] is None else r["doc_id"] for r in got] == sorted(
        -1 if r[0] is None else r[0] for r in odd_rows())
    at, every = 0, []
    for r in got:
        assert r["start"] == at and r["n_tokens"] * 4 == len(r["ids"])
        want[r["doc_id"]].remove(bytes(r["ids"]))
        at += r["n_tokens"]
        every += np.frombuffer(r["ids"], "<u4").tolist()
    asked = [0, 1, at // 2, at - 1, at, -1, 0]
    found = {r["position"]: r["token_id"] for r in dac.read_tokens(
        spark.createDataFrame([(p,) for p in asked], "position long"), path).collect()}
    assert found == {p: every[p] for p in asked if 0 <= p < at}
    path = scratch_dir(spark)
    dac.write_store(none, path, WORD, dropped_spaces, 2)
    assert dac.read_documents(spark, path).count() == 0


def test_packing(spark, odd, none):
    one = whole(BYTE)
    pieces = packing.pack(odd, BYTE, leading_spaces, 1, 64).collect()
    by_window, by_doc = {}, {}
    for p in pieces:
        assert len(p["ids"]) == 4 * p["length"] and p["boundary"] == (p["length"] < 64)
        by_window.setdefault(p["sequence_id"], []).append(p)
        by_doc.setdefault(p["doc_id"], []).append(p)
    for s, own in by_window.items():
        own.sort(key=lambda p: p["offset"])
        assert [p["offset"] for p in own] == list(np.cumsum([0] + [p["length"] for p in own])[:-1])
        assert s == max(by_window) or sum(p["length"] for p in own) == 64
    assert sorted(by_window) == list(range(len(by_window)))
    want = {}
    for doc_id, text, *_ in odd_rows():
        want.setdefault(doc_id, []).append(np.append(one(text), 1).astype("<u4").tobytes())
    for doc_id, codes in want.items():
        own = sorted(by_doc[doc_id], key=lambda p: (p["sequence_id"], p["offset"]))
        cut = []
        for p in own:
            if p["start"] == 0:
                cut.append(b"")
            cut[-1] += bytes(p["ids"])
        assert sorted(cut) == sorted(codes)
    windows = {r["sequence_id"]: bytes(r["ids"]) for r in packing.sequences(
        packing.pack(odd, BYTE, leading_spaces, 1, 64), 64).collect()}
    assert all(len(w) == 256 for w in windows.values())
    for s, own in by_window.items():
        assert windows[s].startswith(b"".join(bytes(p["ids"]) for p in own))
    assert packing.pack(none, BYTE, leading_spaces, 1).count() == 0


def test_crc(spark):
    import pyspark.sql.functions as F
    row = spark.range(1).select(F.crc32(F.lit(b"\x01\x00\x00\x00")).alias("c")).first()
    assert row["c"] == zlib.crc32(b"\x01\x00\x00\x00")
