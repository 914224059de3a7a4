import copy
import json
import random
from dataclasses import replace

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from wordloom.functions import chars
from wordloom.functions.kernel import Kernel
from wordloom.functions.vector import VectorKernel
from wordloom.plans.fixture import _config, model
from wordloom.sources import vocabulary as V


def config(vocab, added=(), **normalizer):
    return {
        "version": "1.0",
        "added_tokens": [{"id": i, "content": t, "normalized": n} for t, i, n in added],
        "normalizer": {"type": "BertNormalizer", **normalizer},
        "pre_tokenizer": {"type": "BertPreTokenizer"},
        "post_processor": {"special_tokens": {t: {"id": t} for t in ("[CLS]", "[SEP]")}},
        "model": {"type": "WordPiece", "unk_token": "[UNK]", "continuing_subword_prefix": "##", "vocab": vocab},
    }


BASE = {"[PAD]": 0, "[UNK]": 100, "[CLS]": 101, "[SEP]": 102, "[MASK]": 103}


def small(*prefixes, suffixes=(), **normalizer):
    vocab = dict(BASE)
    for t in [*prefixes, *("##" + s for s in suffixes)]:
        vocab[t] = len(vocab)
    specials = [(t, i, False) for t, i in BASE.items()]
    return Kernel(V.from_config(config(vocab, specials, **normalizer)))


def test_added_tokens_longest_first_and_without_case():
    vocab = dict(BASE, abcd=104, a=105, cd=106, ab=107)
    added = [(t, i, False) for t, i in BASE.items()] + [(t, vocab[t], True) for t in ("abcd", "a", "cd", "ab")]
    k = Kernel(V.from_config(config(vocab, added)))
    assert k.encode("a abcd bcd abcd cd ab asdf AB ABCD CD A D CD X AbCd", 512) == [
        101, 105, 104, 100, 106, 104, 106, 107, 105, 100, 107, 104, 106, 105, 100, 106, 100, 104, 102,
    ]
    assert k.encode("[pAd]", 512) == [101, 100, 100, 105, 100, 100, 102]
    assert k.encode("app[CLS]ear", 512) == [101, 105, 100, 101, 100, 105, 100, 102]


def test_fallbacks():
    k = small("rhone", "ecole", "lorem", "a", "b", "c", "d", "σ")
    one = lambda t: k.encode(t, 99)[1:-1]
    v = k.model.prefixes
    assert one("Rhône") == one("RHÔNE") == one("rhône") == [v["rhone"]]
    assert one("lo\u0000rem") == one("�lorem​") == [v["lorem"]]
    assert one("​�") == []
    assert one("a b　c\u0085d") == [v[x] for x in "abcd"]
    assert one("漢字") == [100, 100] and one("\U00020000\U00020000") == [100]
    assert one("") == one("   ") == []
    assert one("\u0301") == [100]


def test_cased_models_keep_case_and_accents():
    k = small("Rhône".encode().decode(), lowercase=False, strip_accents=False)
    assert k.encode("rhône", 9) == [101, 100, 102]


def test_lower_case_is_one_to_one():
    assert chars.simple_lower("İΑΣ") == "İασ"


def test_truncation_may_show_pieces_of_a_failed_attempt():
    k = small("r", "rhone", suffixes=("h",))
    assert k.encode("rhône", 3) == [101, k.model.prefixes["r"], 102]
    assert k.encode("rhône", 10) == [101, k.model.prefixes["rhone"], 102]


@pytest.mark.parametrize(
    "text, size, stride, want",
    [
        ("x y z x y", 5, 0, [(0, 4, "C x y z S"), (4, None, "C z x y S")]),
        ("x y z x y", 5, 1, [(0, 4, "C x y z S"), (4, 6, "C z z x S"), (6, None, "C x x y S")]),
        ("x xx y", 4, 1, [(0, 2, "C x S"), (2, None, "C x x S")]),
        ("x xx y", 4, 0, [(0, 2, "C x x S"), (2, 4, "C x ##x S"), (4, None, "C y S")]),
        ("", 4, 0, [(0, None, "C S")]),
    ],
)
def test_chunks(text, size, stride, want):
    k = small("x", "y", "z", suffixes=("x",))
    name = {101: "C", 102: "S", **{i: t for t, i in k.model.prefixes.items() if len(t) == 1}, **{i: "##" + t for t, i in k.model.suffixes.items()}}
    assert [(a, b, " ".join(name[i] for i in ids)) for a, b, ids, _ in k.chunks(text, size, stride)] == want


TEXT = st.lists(st.sampled_from([*"abcxyzé .,!Σ漢\U0001f600\u0301\u200b", "the", " tion", "[SEP]"]), max_size=60).map("".join)


@settings(max_examples=150, deadline=None)
@given(TEXT, st.integers(4, 12), st.integers(0, 3))
def test_chunks_end_and_overlap(text, size, stride):
    stride = min(stride, size - 3)
    found = Kernel(model()).chunks(text, size, stride)
    assert found[0][0] == 0 and found[-1][1] is None
    for (_, following, ids, _), (offset, _, after, _) in zip(found, found[1:]):
        assert offset == following and len(ids) <= size
        shared = ids[1:-1][-stride:] if stride else []
        assert after[1 : 1 + len(shared)] == shared


@settings(max_examples=150, deadline=None)
@given(TEXT, st.integers(2, 40))
def test_truncated_is_whole_where_it_fits(text, limit):
    k = Kernel(model())
    whole = k.encode_all(text)
    cut = k.encode(text, limit)
    assert len(cut) <= limit and cut[0] == whole[0] and cut[-1] == whole[-1]
    if k.memo.longest_attempt + len(whole) < limit:
        assert cut == whole


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from([*"abcdefgh .,!?-é漢", "e\u0301"]), max_size=80).map("".join))
def test_same_as_another_implementation(text):
    tokenizers = pytest.importorskip("tokenizers")
    made = copy.deepcopy(_config())
    for token in made["added_tokens"]:
        token |= {"lstrip": False, "rstrip": False, "special": True}
    made["normalizer"] |= {"clean_text": True, "handle_chinese_chars": True, "strip_accents": None}
    made["model"] |= {"max_input_chars_per_word": 1000}
    made["post_processor"] = {"type": "BertProcessing", "sep": ["[SEP]", 3], "cls": ["[CLS]", 2]}
    made["decoder"] |= {"prefix": "##"}
    other = tokenizers.Tokenizer.from_str(json.dumps(made | {"truncation": None, "padding": None}))
    assert Kernel(model()).encode_all(text) == other.encode(text).ids


def test_decode():
    k = small("lorem", "ip", "sum", ".", "'", "t", "do", "not", suffixes=("m", "sum"))
    p, s = k.model.prefixes, k.model.suffixes
    assert k.decode([]) == ""
    assert k.decode([s["m"], p["ip"], s["sum"], p["."]]) == "##m ipsum."
    assert k.decode([101, p["lorem"], 99999, p["lorem"], 102]) == "[CLS] lorem lorem [SEP]"
    assert k.decode([p["lorem"], p["do"], p["not"]]) == "loremdon't"
    with pytest.raises(KeyError):
        k.decode([99999])
    with pytest.raises(ValueError):
        Kernel(V.from_config(config(dict(BASE, a=7, b=7), [(t, i, False) for t, i in BASE.items()]))).decode([7])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="abcdefghijklmnopqrstuvwxyz", min_size=1, max_size=9), min_size=1, max_size=8).map(" ".join))
def test_decoding_gives_plain_words_back(text):
    k = Kernel(model())
    if " do not" not in f" {text}":
        assert k.decode(k.encode_all(text)) == f"[CLS] {text} [SEP]"


@pytest.mark.parametrize(
    "change",
    [
        lambda c: c.update(version="2.0"),
        lambda c: c["model"].update(type="Other"),
        lambda c: c["normalizer"].update(type="Other"),
        lambda c: c["pre_tokenizer"].update(type="Other"),
        lambda c: c["normalizer"].update(handle_chinese_chars=False),
        lambda c: c["normalizer"].update(clean_text=False),
        lambda c: c["added_tokens"][0].update(single_word=True),
    ],
)
def test_unsupported_configurations(change):
    made = copy.deepcopy(_config())
    change(made)
    with pytest.raises(ValueError):
        V.from_config(made)


def test_missing_specials_and_empty_tokens():
    made = copy.deepcopy(_config())
    made["model"]["vocab"][""] = 9999
    assert "" not in V.from_config(made).prefixes
    del made["model"]["vocab"]["[SEP]"]
    with pytest.raises(V.ModelError):
        V.from_config(made)


def test_vocab_txt(tmp_path):
    path = tmp_path / "vocab.txt"
    path.write_text("[UNK]\n[SEP]\n[CLS]\n[PAD]\n\nab\n##c\nab\n", encoding="utf-8")
    m = V.load_vocab_txt(str(path), True)
    assert m.prefixes == {"ab": 7} and m.suffixes == {"c": 6} and m.pad == ("[PAD]", 3)
    k = Kernel(m)
    assert k.encode("ABC [SEP]", 9) == [2, 7, 6, 0, 1]
    with pytest.raises(KeyError):
        k.decode([2])
    for missing in ("[UNK]", "[SEP]", "[CLS]", "[PAD]"):
        with pytest.raises(V.ModelError):
            V.from_lines([t for t in ("[UNK]", "[SEP]", "[CLS]", "[PAD]") if t != missing], True)
    with pytest.raises(ValueError):
        V.from_lines(None, True)


def test_json_file(tmp_path):
    (tmp_path / "tokenizer.json").write_text(json.dumps(_config()), encoding="utf-8")
    assert V.load_pretrained(str(tmp_path)).key == model().key
    with pytest.raises(FileNotFoundError):
        V.load_pretrained(str(tmp_path / "none"))


def _odd_texts():
    rng, parts = random.Random(1), [*"ab é789 漢.\u0301İΣ\u200b\U0001f600\n", "[CLS]", "the ", "Rhône", "nation", "\ufffd"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(0, 60))) for _ in range(400)]
    return [*texts, "", None, "the" * 200, "é" * 150, "word " * 3000, "x" * 70, "x" * 70 + "y", "\ud800".encode("utf-8", "replace").decode()]


@pytest.mark.parametrize("form", ["NFD", "NFC", "NFKC"])
def test_whole_columns_equal_single_texts(form):
    texts, one, whole = _odd_texts(), Kernel(model(form)), VectorKernel(Kernel(model(form)))
    column = pa.chunked_array([pa.array(["skipped", *texts])]).chunk(0).slice(1)
    each = lambda f: [None if t is None else f(t) for t in texts]
    for _ in range(2):
        assert whole.encode(column, None).to_pylist() == each(one.encode_all)
    for limit in (2, 3, 4, 7, 32, 512):
        assert whole.encode(column, limit).to_pylist() == each(lambda t: one.encode(t, limit))
    for size, stride in ((3, 0), (4, 0), (4, 1), (5, 2), (8, 3), (16, 0), (64, 10)):
        found = [[(a, b, ids.tolist(), lost) for a, b, ids, lost in rows] for _, rows in whole.chunks(column, size, stride)]
        assert found == [[] if t is None else [(a, b, list(ids), lost) for a, b, ids, lost in one.chunks(t, size, stride)] for t in texts]
    ids = whole.encode(column, 64)
    assert whole.decode(ids).to_pylist() == [None if t is None else one.decode(one.encode(t, 64)) for t in texts]
    assert whole.encode(column.slice(0, 0), 9).to_pylist() == [] and whole.decode(ids.slice(0, 0)).to_pylist() == []


def test_whole_columns_with_other_added_tokens():
    added = (*model().added, V.AddedToken("cat", True), V.AddedToken("x.y", False))
    own = replace(model(), added=added, prefixes=dict(model().prefixes, **{"cat": 7, "x.y": 8}))
    texts = ["concatenate [CLS] CAT x.y.x [cls]", "the hat", "x.yx.y cat", "xx.y the"]
    one, whole = Kernel(own), VectorKernel(Kernel(own))
    assert whole.encode(pa.array(texts), None).to_pylist() == [one.encode_all(t) for t in texts]
    assert whole.encode(pa.array(texts), 5).to_pylist() == [one.encode(t, 5) for t in texts]


def test_the_pool_starts_over_when_full(monkeypatch):
    whole, one = VectorKernel(Kernel(model())), Kernel(model())
    texts = [f"word{k} the{k}" for k in range(50)]
    monkeypatch.setattr(whole.pool, "rows", (1 << 19) + 1)
    assert whole.encode(pa.array(texts), None).to_pylist() == [one.encode_all(t) for t in texts] and whole.pool.rows < 1000


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=6), st.integers(2, 12))
def test_any_columns_equal_single_texts(texts, limit):
    one, whole = Kernel(model()), VectorKernel(Kernel(model()))
    assert whole.encode(pa.array(texts, pa.string()), limit).to_pylist() == [one.encode(t, limit) for t in texts]
