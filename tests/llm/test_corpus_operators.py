"""Each corpus operator against brute force on small tables, with nulls, empty, long and repeated texts, clashing columns."""

import hashlib
import html
import os
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sparklog.llm import bpe, html_text, langid, licenses, media, ngram_join, packing, queries, shared, substring, token_counts, winnow

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")
_SPACE = re.compile("[\x20\x09-\x0d]+")
_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, ids string, `group` string, bucket string, n string, start string, media string"


def prose(rng, n, words=("alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta", "theta", "iota", "kappa")):
    return " ".join(rng.choice(words) + rng.choice(("", "", "s", "x", "42")) for _ in range(n))


def texts(seed=3):
    rng = random.Random(seed)
    base = [prose(rng, rng.randint(1, 120)) for _ in range(25)]
    passage = " ".join(f"w{i}" for i in range(60))
    near = base[5].split()
    long = prose(rng, 9000)
    edited = long.split()
    edited[::400] = ["changed"] * len(edited[::400])
    out = [None, "", " \n\t ", "one", "two words", "THREE Words here", "Three words HERE", "naïve café 漢字 🙂 é", "a\x1cb\x85c\xa0d", "﻿x  y\n\n z", "don't  stop!! it's 3.14"]
    out += base + [base[3], base[3], base[7] + " " + passage, passage + " " + base[8], passage[:200] + " tail " + passage, long, " ".join(edited), "x" * 30000, "la " * 500]
    if len(near) > 30:
        near[10] = "other"
        out.append(" ".join(near))
    return out


def table(spark, values=None, ids=None):
    values = texts() if values is None else values
    ids = list(range(len(values))) if ids is None else ids
    rows = [(i, t, "xx", "s", len(t or ""), "c", "g", "b", "n", "s", "m") for i, t in zip(ids, values)]
    return spark.createDataFrame(rows, _SCHEMA).repartition(3)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def words(text):
    return [w for w in _SPACE.split(text or "") if w]


# --- tokens ----------------------------------------------------------------------------------------------


def test_bpe_is_exact_and_decodes(spark):
    oracle = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})
    docs = table(spark)
    out = by_id(bpe.decode_documents(bpe.encode_documents(docs, RANKS), RANKS))
    for i, text in enumerate(texts()):
        assert list(out[i]["ids"]) == oracle.encode_ordinary(text or ""), text
        assert bytes(out[i]["decoded"]) == (text or "").encode()


def test_bpe_on_random_text():
    encoder = bpe.encoder_of(RANKS)
    oracle = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=encoder.ranks, special_tokens={})
    rng = random.Random(1)
    alphabet = "ab e\n\t \r \x1c 'sdlvéß漢🙂٣½_-!?.,019THE"
    for _ in range(5000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30)))
        assert encoder.encode(text) == oracle.encode_ordinary(text)


def test_bpe_memo_is_bounded(monkeypatch):
    encoder = bpe.BytePairEncoder(bpe.read_ranks(RANKS))
    monkeypatch.setattr(encoder, "CACHED", 10)
    rng = random.Random(2)
    text = " ".join(str(rng.random()) for _ in range(300))
    first = encoder.encode(text)
    assert encoder.encode(text) == first and len(encoder.memo) <= 10 and len(encoder.older) <= 10


def test_packing_holds_every_id_once(spark):
    oracle = Tokenizer.from_file(WORDS)
    values = [*texts(), "<|endoftext|> in text", "<|STARTOFTEXT|>x|y z.,*** Ünder|"]
    pieces = queries_of(packing.pack_documents(table(spark, values), WORDS, 2, 256).withColumn("crc", queries.ids_crc32("ids")))
    assert len({p["sequence_id"] for p in pieces}) == len(pieces)
    found = defaultdict(list)
    for p in pieces:
        assert p["length"] == len(p["ids"]) == 1 << p["bucket"] <= 256 and p["offset"] == 0
        assert p["crc"] == zlib.crc32(np.asarray(p["ids"], "<u4").tobytes())
        found[p["doc_id"]].append(p)
    for i, text in enumerate(values):
        ids, at = oracle.encode(text or "", add_special_tokens=False).ids + [2], 0
        for p in sorted(found[i], key=lambda p: p["start"]):
            assert p["start"] == at and list(p["ids"]) == ids[at : at + p["length"]] and p["doc_tokens"] == len(ids)
            at += p["length"]
        assert at == len(ids)


def queries_of(df):
    return df.collect()


def test_packing_repeated_rows_and_bad_length(spark):
    pieces = packing.pack_documents(table(spark, ["same text", "same text", None], [1, 1, None]), WORDS, 2).collect()
    assert len({p["sequence_id"] for p in pieces}) == len(pieces) and sum(p["doc_tokens"] for p in pieces if p["doc_id"] is None) == 1
    with pytest.raises(ValueError):
        packing.pack_documents(table(spark), WORDS, 2, 100)


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_token_counts_add_up(spark, rule):
    docs = table(spark)
    encoder = bpe.encoder_of(RANKS)
    sums, ends = defaultdict(int), {}
    for r in token_counts.section_counts(docs, RANKS, rule).collect():
        sums[r["doc_id"]] += r["n_tokens"]
        ends[r["doc_id"]] = max(ends.get(r["doc_id"], 0), r["end"])
    for i, text in enumerate(texts()):
        assert sums[i] == len(encoder.encode(text or "")) and ends[i] == len(text or "")


def test_token_counts_of_fields_and_boundaries(spark):
    rows = spark.createDataFrame([(1, "Hello wor", "ld again", None)], "doc_id long, a string, b string, c string")
    out = {r["section"]: r for r in token_counts.field_counts(rows, "doc_id", ["a", "b", "c"], RANKS, "first", "").collect()}
    encoder = bpe.encoder_of(RANKS)
    assert sum(r["n_tokens"] for r in out.values()) == len(encoder.encode("Hello world again"))
    assert out[0]["n_crossing"] == out[1]["n_crossing"] == 1 and out[2]["n_tokens"] == 0
    first, last = np.array([0, 4]), np.array([3, 9])
    starts = np.array([0, 5])
    assert token_counts.allocate(first, last, starts, 10, "first")[0].tolist() == [2, 0]
    assert token_counts.allocate(first, last, starts, 10, "last")[0].tolist() == [1, 1]
    assert token_counts.allocate(first, last, starts, 10, "largest")[0].tolist() == [1, 1]


# --- language, licences ----------------------------------------------------------------------------------

_LANGS = {"aa": ("zor", "mek", "tal", "vin"), "bb": ("lua", "oie", "aeu", "iou"), "cc": ("krst", "bzg", "pltr", "dvr")}


def _language_rows(seed=0, n=60):
    rng = random.Random(seed)
    rows = []
    for lang, parts in _LANGS.items():
        for _ in range(n):
            rows.append((len(rows), " ".join("".join(rng.choice(parts) for _ in range(3)) for _ in range(rng.randint(3, 60))).title(), lang))
    return rows


def test_language_of_held_out_documents(spark):
    docs = spark.createDataFrame(_language_rows(), "doc_id long, text string, lang string")
    model = langid.learn(docs.filter(langid.fold() != 1))
    out = langid.identify(docs.drop("lang"), model).withColumn("fold", langid.fold()).collect()
    truth = {i: lang for i, _, lang in _language_rows()}
    held = [r for r in out if r["fold"] == 1]
    assert all(r["fold"] == zlib.crc32(str(r["doc_id"]).encode()) % 3 for r in out)
    assert np.mean([r["language"]["lang"] == truth[r["doc_id"]] for r in held]) > 0.97
    assert all(0 <= r["language"]["score"] <= 1 for r in out)


def test_language_mixtures_and_edges(spark):
    rows = _language_rows()
    model = langid.learn(spark.createDataFrame([*rows, (None, None, "dd"), (999, "text", None)], "doc_id long, text string, lang string"))
    assert model.languages == ("aa", "bb", "cc")
    aa, bb = (" ".join(t for _, t, lang in _language_rows(9, 8) if lang == x) for x in ("aa", "bb"))
    shares = {x["lang"]: x["share"] for x in next(model.results([aa + " " + bb]))["languages"]}
    assert set(shares) == {"aa", "bb"} and 0.25 < shares["aa"] < 0.75
    assert [r["lang"] for r in model.results([None, "", "12 -- !", aa, aa])] == ["und", "und", "und", "aa", "aa"]
    none = langid.learn(spark.createDataFrame([], "doc_id long, text string, lang string"))
    assert next(none.results(["words"]))["lang"] == "und"
    assert by_id(langid.identify(table(spark), model))[0]["language"]["lang"] == "und"


def test_language_settings_do_not_change_with_order(spark):
    docs = spark.createDataFrame(_language_rows(), "doc_id long, text string, lang string")
    a, b = langid.learn(docs.repartition(5)), langid.learn(docs.coalesce(1))
    assert np.array_equal(a.log_likelihood, b.log_likelihood)


@pytest.fixture(scope="module")
def licence_model():
    return licenses.train()


def test_licences_are_found_and_everyday_text_is_not(licence_model):
    lines = {
        "Licensed under the Apache License, Version 2.0.": "Apache-2.0", "Released under the MIT License.": "MIT", "This work is licensed under the GNU General Public License, version 3.": "GPL",
        "Licensed under CC BY-NC 4.0.": "CC-BY-NC", "All rights reserved.": "proprietary", "The code is made available under the BSD 3-Clause License.": "BSD",
    }
    for line, family in lines.items():
        n, found = licence_model.scan(f"Some words.\n{line}\n\nmore of the words of the text")
        assert n == 3 and [f["family"] for f in found] == [family] and found[0]["start"] == 12
    for line in ("The driver lost his license in the accident.", "A free program was published in May.", "", None, " \n ", "of the and"):
        assert licence_model.scan(line)[1] == []


def test_licence_classifier_on_held_out_examples(licence_model):
    paragraphs, classes, _ = licenses.examples(seed=11)
    assert (licence_model.probabilities(paragraphs).argmax(axis=1) == classes).mean() > 0.95


def test_licences_of_other_families_are_unknown(licence_model):
    notices = (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License v2.0 which accompanies this distribution.",
        "Distributed under the Boost Software License, Version 1.0.", "Licensed under the EUPL, Version 1.2 or later", "Released under the Artistic License 2.0.",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
        "You may use this tool under the terms of the Acme Research License; redistribution is not permitted.", "This font is licensed under the SIL Open Font License, Version 1.1.",
    )
    for line in notices:
        n, found = licence_model.scan(f"Some words.\n{line}\nmore of the words of the text")
        assert n == 3 and [(f["family"], f["start"], f["end"]) for f in found] == [("unknown", 12, 12 + len(line))], line
        assert found[0]["confidence"] >= licence_model.threshold
    for line in ("The The The The The The The The", "This.", "Mit und.", "The committee reviewed the license application of the restaurant.", "The public library offers free copies of software."):
        assert licence_model.scan(line)[1] == [], line


def test_licence_scan_of_a_table(spark, licence_model):
    out = by_id(licenses.scan_documents(table(spark, [None, "", "Released under the MIT License.\nx"]), licence_model))
    assert [out[i]["n_paragraphs"] for i in range(3)] == [0, 0, 2] and out[2]["licences"][0]["family"] == "MIT"


# --- fingerprints ----------------------------------------------------------------------------------------


def test_winnowing_keeps_the_rightmost_minimum_of_each_window(spark):
    docs = table(spark)
    units = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"(\S{1,6})"), F.lit(1))
    grams = F.transform(F.sequence(F.lit(0), F.greatest(F.size(units) - 4, F.lit(0))), lambda i: F.shiftrightunsigned(F.xxhash64(*[F.get(units, i + j) for j in range(4)]), 32))
    rows = by_id(winnow.fingerprint(docs.filter(F.length("text") < 2000), 4, 8).select("doc_id", "fingerprint", grams.alias("grams"), F.size(units).alias("units")))
    for r in rows.values():
        h, expected = r["grams"], set()
        for s in range(max(1, len(h) - 7)) if r["units"] else ():
            part = list(enumerate(h[s : s + 8], s))
            least = min(v for _, v in part)
            expected.add(max((i, v) for i, v in part if v == least))
        assert {((1 << 31) - 1 - (v & ((1 << 31) - 1)), v >> 31) for v in r["fingerprint"]} == expected


def test_edited_texts_and_likeness(spark):
    values = texts()
    docs = table(spark, [*values, "of no id"], [*range(len(values)), None])
    rows = winnow.edited_against_next(docs).withColumns({"a": winnow.hashes(F.col("fingerprint")), "b": winnow.hashes(F.col("edited_fingerprint"))})
    out = by_id(rows.withColumn("near", winnow.likeness(F.col("a"), F.col("b"))))
    order = [*range(len(values) - 1, -1, -1), None]
    full = {**{i: t or "" for i, t in enumerate(values)}, None: "of no id"}
    for at, i in enumerate(order):
        text, after = full[i], full[order[(at + 1) % len(order)]]
        half = len(text) // 2
        assert out[i]["edited"] == text[: len(text) - half] + after[:half]
        assert 0 <= out[i]["near"] <= 1
    same = [k for k, t in enumerate(values) if t == values[14]]
    assert len({tuple(out[k]["fingerprint"]) for k in same}) == 1 and len(same) == 3


def _winnowed_characters(text, k, w):
    """(position, 33 bits of hash, compared as signed numbers) by brute force."""
    white = lambda c: c.isspace() and not "\x1c" <= c <= "\x1f"
    chars = [(i, " " if white(c) else c) for i, c in enumerate(text or "") if not (white(c) and i and white(text[i - 1]))]
    whole = "".join(c for _, c in chars)
    if not whole.strip(" "):
        return []
    hashed = lambda s: int.from_bytes(xxhash.xxh64_digest(s.encode("utf-32-be"), 42), "big", signed=True) >> 31
    if len(whole) < k:
        return [(0, hashed(whole.strip(" ")))]
    each = [(chars[i][0], hashed(whole[i : i + k])) for i in range(len(whole) - k + 1)]
    return sorted({min(each[s : s + w], key=lambda x: (x[1], -x[0])) for s in range(max(1, len(each) - w + 1))})


def _signed(h):
    return int(h, 16) - (int(h, 16) >> 32 << 33)


def test_fingerprints_by_characters(spark):
    rng = random.Random(8)
    values = [t for t in texts() if len(t or "") < 3000] + ["".join(rng.choice("ab \n\u3000\xa0\t漢🙂é\x1c") for _ in range(rng.randint(0, 300))) for _ in range(60)]
    values += ["".join(rng.choice("abc漢🙂é") for _ in range(rng.randint(0, 400))) for _ in range(60)] + ["ab" * 200, "x" * 29 + " ".join("abcdefgh" for _ in range(60))]
    for k, w in ((24, 43), (5, 4), (3, 1), (2, 30)):
        out = by_id(winnow.fingerprint_characters(table(spark, values), k, w).select("doc_id", winnow.as_text(F.col("fingerprint")).alias("fingerprint")))
        for i, text in enumerate(values):
            assert [(int(p), _signed(h)) for h, p in (x.split(":") for x in out[i]["fingerprint"].split())] == _winnowed_characters(text, k, w), text


def test_fingerprints_of_edited_texts_are_those_of_the_texts(spark):
    """Put together from two fingerprints, they are the same as if the edited text were hashed alone."""
    rng = random.Random(12)
    values = [t for t in texts() if len(t or "") < 3000]
    values += [rng.choice(("", " ")).join(rng.choice(("ab", "c", "漢", "🙂é", "ontion")) for _ in range(rng.randint(0, 900))) + rng.choice(("", "\n", "  ")) for _ in range(120)]
    values += ["x" * 900, "ab" * 700, "y" * 2000, "z  z" + "w" * 1500]
    rng.shuffle(values)
    for k, w in ((24, 43), (5, 4), (3, 1)):
        rows = winnow.edited_against_next(table(spark, values), k, w)
        out = rows.select("doc_id", "edited", winnow.as_text(F.col("edited_fingerprint")).alias("found")).collect()
        assert len(out) == len(values)
        for r in out:
            assert [(int(p), _signed(h)) for h, p in (x.split(":") for x in r["found"].split())] == _winnowed_characters(r["edited"], k, w), r["edited"]


def test_a_character_put_into_text_without_spaces(spark):
    rng = random.Random(5)
    chinese = "".join(chr(rng.randint(0x4E00, 0x9FA5)) for _ in range(2000))
    base64 = "".join(rng.choice("ABCDEFGHabcdefgh0123456789+/") for _ in range(2000))
    spaced = "".join(c + ("\u3000" if i % 40 == 39 else "") for i, c in enumerate(chinese))
    for text in (chinese, base64, spaced):
        rows = winnow.edited_against_next(table(spark, [text, text[:5] + "x" + text[5:]]))
        row = by_id(rows.select("doc_id", winnow.likeness(winnow.hashes(F.col("fingerprint")), winnow.hashes(F.col("next_fingerprint"))).alias("near")))[1]
        assert row["near"] > 0.9


def test_buckets_of_ids(spark):
    docs = table(spark, [f"text {i}" for i in range(300)], [i * i * 7 - 500 for i in range(300)])
    work = docs.select("doc_id", "text")
    rows = winnow.with_next(work, lambda df: df, bucket_bytes=100).collect()
    after = {r["doc_id"]: r["next_text"] for r in rows}
    ids = sorted(after, reverse=True)
    number = {i * i * 7 - 500: f"text {i}" for i in range(300)}
    assert len(ids) == 300 and all(after[i] == number[ids[(k + 1) % 300]] for k, i in enumerate(ids))


# --- media, pages ----------------------------------------------------------------------------------------


def test_media_round_trip(spark):
    out = by_id(media.store_texts(table(spark)))
    for i, text in enumerate(texts()):
        data = (text or "").encode()
        assert bytes(out[i]["payload"]) == media.padded(data) and out[i]["n_bytes"] == len(data)
        frames, rate = media.read_avi(bytes(out[i]["media"]))
        clips = out[i]["clips"]
        assert rate == media.FPS and clips[0]["start"] == 0 and clips[-1]["end"] == len(frames)
        assert all(a["end"] == b["start"] for a, b in zip(clips, clips[1:]))
    rows = media.clips_of(media.store_texts(table(spark)), "doc_id", "media")
    assert rows.count() == sum(len(r["clips"]) for r in out.values())


def test_media_shots_index_and_errors():
    rng = np.random.default_rng(0)
    dark, light = rng.integers(0, 60, 10 * 576), rng.integers(180, 255, 8 * 576)
    payload = np.concatenate([dark, light]).astype(np.uint8).tobytes()
    data = media.write_avi(payload)
    frames, _ = media.read_avi(data)
    assert media.shots(frames).tolist() == [0, 10]
    extremes = bytes([0, 255] * 288)  # differences of 255 need byte stuffing
    assert media.read_avi(media.write_avi(extremes))[0].tobytes() == extremes
    bare = data[: data.rindex(b"idx1")]
    bare = bare[:4] + (len(bare) - 8).to_bytes(4, "little") + bare[8:]
    assert media.read_avi(bare)[0].tobytes() == payload
    assert len(media.read_avi(media.write_avi(b""))[0]) == 0
    d = media._differences(frames[:1])
    begin, height, width, table_ = media._jpeg_layout(data[slice(*media._frame_places(data)[0][0])])
    coded = media._WORD[d + 255].astype(">u2").tobytes()
    assert np.array_equal(media._decode_bits(coded, table_, height * width), d.ravel())
    with pytest.raises(ValueError):
        media.read_avi(b"RIFF0000WAVE")
    with pytest.raises(ValueError):
        media.write_avi(b"x")


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a><li><a href=/b>B</a></ul></nav><div class="ad">Buy this now, it is very good and long enough to be text.</div>
<article><h1>A  title</h1><p><b>First&amp;long   paragraph of the article, with many words in it.<br><p>Second &lt;one&gt;&nbsp;is here too, also with a good number of words.
</p><p>Short.</p><form><input><button>Send</button></form><aside>By the way</aside><section class="comments"><p>I like this article very much, thank you for writing it all.</p></section></article>
<div id="sidebar"><p>Related things that one could read after this page, if one wants to.</p></div><div class="cookie-notice">We use cookies on this page.</div><footer>&copy; me</footer></body></html>"""


def test_main_text_of_pages(spark):
    expected = "A title\nFirst&long paragraph of the article, with many words in it.\nSecond <one> is here too, also with a good number of words.\nShort."
    assert html_text.main_text(PAGE) == expected
    plain = PAGE.replace("<article>", "<div class=content>").replace("</article>", "</div>")
    assert html_text.main_text(plain) == expected
    assert html_text.main_text("<p>cut off &am") == "cut off &am" and html_text.main_text("<p>cut &amp") == "cut &"
    assert html_text.main_text("just text") == "just text" and html_text.main_text("<div") == ""
    assert [html_text.main_text(x) for x in (None, "", "<p></p>", "<script>x")] == [""] * 4
    rows = spark.createDataFrame([(1, PAGE, "clash"), (2, None, "clash")], "page_id long, html string, n string")
    assert [r["text"] for r in html_text.extract_pages(rows).orderBy("page_id").collect()] == [expected, ""]


def test_main_text_keeps_every_block_of_articles():
    rng = random.Random(5)
    for _ in range(30):
        blocks = [prose(rng, rng.randint(1, 60)) + rng.choice(("", " & <x>")) for _ in range(rng.randint(1, 12))]
        body = "".join(f"<p>{html.escape(b)}" + rng.choice(("</p>", "")) for b in blocks)
        page = f"<nav><a>x</a><a>y</a></nav><article>{body}</article><footer>{prose(rng, 30)}</footer>"
        assert html_text.main_text(page) == "\n".join(blocks)


# --- repeats and near duplicates -------------------------------------------------------------------------


def brute_repeats(rows, window):
    seen, out = set(), {}
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        own = words(text)
        covered = [False] * len(own)
        for s in range(len(own) - window + 1):
            key = tuple(own[s : s + window])
            if key in seen:
                covered[s : s + window] = [True] * window
            seen.add(key)
        out[i] = (len(own), sum(covered), " ".join(w for w, c in zip(own, covered) if not c))
    return out


@pytest.mark.parametrize(("window", "prefix", "group_bytes"), [(20, 8, 24_000_000), (20, 8, 4_000), (6, 3, 10_000), (4, 4, 10_000)])
def test_repeated_passages(spark, window, prefix, group_bytes):
    rows = list(enumerate(texts()))
    out = by_id(substring.drop_repeated(table(spark), window, prefix, group_bytes))
    expected = brute_repeats(rows, window)
    assert {i: (r["n_words"], r["n_removed"], r["kept_text"]) for i, r in out.items()} == expected


def test_repeated_passages_of_random_documents(spark):
    rng = random.Random(8)
    values = [" ".join(rng.choice("ab") for _ in range(rng.randint(0, 60))) for _ in range(60)]
    ids = rng.sample(range(-100, 100), 60)
    out = by_id(substring.drop_repeated(table(spark, values, ids), 7, 3, 300))
    assert {i: (r["n_words"], r["n_removed"], r["kept_text"]) for i, r in out.items()} == brute_repeats(list(zip(ids, values)), 7)


def test_repeated_passages_edges(spark):
    passage = " ".join(f"w{i}" for i in range(30))
    docs = table(spark, [passage, passage, "a b\n" + passage + "\n c", None], [None, 5, 7, 9])
    out = by_id(substring.drop_repeated(docs, 20, keep=["source", "n"], layout=True))
    assert [out[None]["n_removed"], out[5]["n_removed"], out[7]["n_removed"]] == [0, 30, 30]
    assert out[7]["kept_text"] == "a b\nc" and out[9]["kept_text"] is None and out[9]["source"] == "s" and out[None]["kept_text"] == passage
    twice = substring.drop_repeated(table(spark, [passage, passage], [3, 3]), 20).collect()
    assert [r["n_removed"] for r in twice] == [0, 0]
    assert substring.drop_repeated(table(spark).limit(0), 20).count() == 0


def shingles(text, n):
    own = [w.translate({c: c + 32 for c in range(65, 91)}) for w in words(text)]
    return frozenset(tuple(own[k : k + n]) for k in range(max(1, len(own) - n + 1))) if own else frozenset()


def brute_components(rows, n, percent):
    sets = {i: shingles(t, n) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def _near_copies(seed, many, length, edits):
    rng = random.Random(seed)
    own = [f"v{rng.randint(0, 10**6)}" for _ in range(length)]
    out = [" ".join(own)]
    for _ in range(many):
        copy = list(own)
        for _ in range(rng.randint(0, edits)):
            copy[rng.randrange(length)] = f"e{rng.randint(0, 10**6)}"
        out.append(" ".join(copy))
    return out


@pytest.mark.parametrize(("n", "percent", "frequent"), [(4, 85, 100), (5, 80, 100), (4, 85, 3)])
def test_similarity_components(spark, n, percent, frequent):
    values = texts() + _near_copies(1, 25, 60, 4) + _near_copies(2, 12, 300, 14) + _near_copies(3, 3, 12, 1)
    rows = list(enumerate(values))
    out = by_id(ngram_join.similarity_components(table(spark, values), n, percent, frequent=frequent, group_bytes=20_000))
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in out.items()} == brute_components(rows, n, percent)


def test_similarity_edges(spark):
    docs = table(spark, ["a b c d e", "A B C D E", None, "", "a b c d e"], [None, 4, 5, 6, 4])
    out = ngram_join.similarity_components(docs).collect()
    assert sorted((r["doc_id"] or -1, r["n_shingles"], r["component_id"]) for r in out if r["doc_id"] in (4, 5, 6)) == [(4, 2, None), (4, 2, None), (5, 0, 5), (6, 0, 6)]
    assert ngram_join.similarity_components(table(spark).limit(0)).count() == 0


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 130)] + [(7, 7), (200, 199), (199, 200)]
    found = {r["node"]: r["component"] for r in shared.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {found[i] for i in range(41)} == {0} and {found[i] for i in range(100, 130)} == {100} and found[200] == 199 == found[199]


# --- the queries and the pipeline ------------------------------------------------------------------------


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("sf"))
    rows = [(i, t, "xx" if i % 2 else "yy", "s", len(t or "")) for i, t in enumerate(texts() + _near_copies(1, 6, 80, 2))]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, "http://x", PAGE), (2, None, None)], "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    return folder


def test_every_query_runs_over_all_rows(spark, sf_dir):
    documents = len(texts()) + 7
    for name, query in queries.queries().items():
        out = query(spark, sf_dir)
        assert out.select("page_id" if name.startswith("op7_") else "doc_id").distinct().count() == (2 if name.startswith("op7_") else documents), name


def test_digests(spark, sf_dir):
    out = by_id(queries.op6_media_columns(spark, sf_dir))
    tokens = by_id(queries.op1_byte_bpe(spark, sf_dir))
    kept = by_id(queries.op9_substring_dedup(spark, sf_dir))
    encoder = bpe.encoder_of(RANKS)
    for i, text in enumerate(texts()):
        data = (text or "").encode()
        payload = media.padded(data)
        assert out[i]["payload_sha256"] == hashlib.sha256(payload).hexdigest() and out[i]["tail_crc32"] == zlib.crc32(payload[-32:])
        ids = " ".join(map(str, encoder.encode(text or "")))
        assert tokens[i]["ids_sha256"] == hashlib.sha256(ids.encode()).hexdigest() and tokens[i]["decoded_sha256"] == hashlib.sha256(data).hexdigest()
    assert all(len(r["kept_sha256"]) == 64 for r in kept.values())


def test_pipeline_against_brute_force(spark, sf_dir):
    import corpus_pipeline as pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    known = pipeline.language(spark, docs, sf_dir)
    assert known.columns == docs.columns
    rows = {r["doc_id"]: r["text"] for r in known.collect()}
    assert all(rows.values()) and len(rows) >= len(texts()) - 5
    groups = brute_components(rows.items(), pipeline.SHINGLE_WORDS, pipeline.SIMILAR_PERCENT)
    first = {i: t for i, t in rows.items() if groups[i][1] == i}
    second = shared.stored(pipeline.near_duplicates(spark, known, sf_dir), "t")
    assert {r["doc_id"]: r["text"] for r in second.collect()} == first and second.columns == docs.columns
    third = pipeline.repeated_passages(spark, second, sf_dir)
    assert third.columns == docs.columns
    cut = brute_repeats(first.items(), pipeline.PASSAGE_WORDS)
    got = {r["doc_id"]: r for r in third.collect()}
    assert all(" ".join(words(r["text"])) == cut[i][2] and r["n_chars"] == len(r["text"]) for i, r in got.items()) and got.keys() == first.keys()
    assert all(got[i]["text"] == first[i] for i in first if not cut[i][1])
    oracle = Tokenizer.from_file(WORDS)
    oracle.encode_special_tokens = True
    ids = defaultdict(dict)
    for p in pipeline.run(spark, sf_dir).collect():
        ids[p["doc_id"]][p["start"]] = list(p["ids"])
    for i, r in got.items():
        joined = [x for _, part in sorted(ids[i].items()) for x in part]
        assert joined == oracle.encode(r["text"], add_special_tokens=False).ids + [2]


def test_pipeline_on_an_empty_table(spark):
    import corpus_pipeline as pipeline

    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long, extra string")
    for _, stage in pipeline.STAGES[:-1]:
        docs = shared.stored(stage(spark, docs, ""), "e")
        assert docs.columns[-1] == "extra" and docs.count() == 0
    assert pipeline.packed(spark, docs, "").count() == 0


def test_no_query_needs_a_session_to_be_listed():
    assert os.system(f"cd {os.path.dirname(os.path.dirname(os.path.dirname(__file__)))} && python -c 'import __spark_entry__ as e; assert len(e.queries()) > 20'") == 0
