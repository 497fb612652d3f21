"""Each operator against a plain version of its contract, on awkward rows and on the small documents table."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash

from stratica.llm import bpe, chat, langid, licenses, lm, packing, quality, queries, simhash
from tests.llm.fixtures import awkward, empty, rows_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text: str | None) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def both(spark, documents):
    return awkward(spark).select("doc_id", "text", "lang").unionByName(documents.select("doc_id", "text", "lang"))


def pairs(df) -> list[tuple]:
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def test_bpe_equals_the_library(spark, documents):
    from tokenizers import Tokenizer

    docs = both(spark, documents)
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    expected = []
    for key, text in pairs(docs):
        ids = library.encode(text or "", add_special_tokens=False).ids
        expected.append((key, tuple(ids), library.decode(ids, skip_special_tokens=False)))
    for size in (0, 50, 60_000):
        codec = bpe.Codec(docs, path, lexicon_words=size)
        assert rows_of(codec.decode(codec.encode(docs)), "doc_id", "ids", "decoded") == sorted(expected, key=repr)
        assert rows_of(codec.round_trip(docs), "doc_id", "ids", "decoded") == sorted(expected, key=repr)
    assert codec.decode(codec.encode(empty(spark))).count() == 0 and codec.round_trip(empty(spark)).count() == 0


def test_license_base_columns(spark, documents):
    phrases = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
    docs = both(spark, documents)
    expected = []
    for key, text in pairs(docs):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
        starts = [(k, label) for p, label in phrases.items() for k in range(len(words)) if words[k : k + len(p.split())] == p.split()]
        places = [k for k, _ in starts]
        expected.append((key, len(words), len(starts), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in starts}))))
    found = licenses.scan_licenses(docs)
    assert rows_of(found, "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels") == sorted(expected, key=repr)
    for r in found.collect():
        assert set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(","))) and 0 <= r["score"] <= 1
    assert licenses.scan_licenses(empty(spark)).count() == 0


@pytest.mark.parametrize(
    "text,label",
    [
        ("Permision is hereby granted, free of charge, to any person", "mit"),
        ("this is licenced under the Apache License version two", "apache-2.0"),
        ("see the GNU Lesser General Publik License for details", "lgpl"),
        ("nothing of the kind is said here", None),
    ],
)
def test_license_fuzzy(spark, text, label):
    row = licenses.scan_licenses(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (label in row["labels"].split(",")) if label else row["labels"] == ""


@pytest.mark.parametrize(
    "text,labels",
    [
        ("this is released under the BSD license", "bsd"),
        ("this is released under the ISC license", "isc"),
        ("this is released under the GPL license", "gpl"),
        ("this is released under the MIT license", "mit"),
        ("this is released undr the MIT licence", "mit"),
        ("this is released under the XYZ license", ""),
        ("licensed under CC BY 4.0", "cc-by"),
        ("licensed under CC BY-SA 4.0", "cc-by,cc-by-sa"),
        ("licensed under CC BY-ND 4.0", "cc-by,cc-by-nd"),
        ("licensed under CC BY-NC 4.0", "cc-by,cc-by-nc"),
        ("GNU Affero General Public License", "agpl,gpl"),
        ("GNU Lesser General Public License", "gpl,lgpl"),
        ("released under the BSD license. Parts are released under the MIT license", "bsd,mit"),
    ],
)
def test_license_labels_do_not_turn_into_each_other(spark, text, labels):
    """The base phrase ``general public license`` is in every one of its family."""
    row = licenses.scan_licenses(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row["labels"] == labels
    words = [w for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))]
    for m in row["matches"]:
        assert " ".join(words[m["start_word"] :]).startswith(m["found"])


def test_license_fuzzy_equals_search_without_seeds(spark, documents):
    """The seeds lose no place: every notice is also searched for by the regex library over the whole text."""
    import regex

    docs = both(spark, documents).where("doc_id >= 1000000 or doc_id % 9 = 0").where("length(text) < 6000")
    slow = {n: regex.compile(rf"(?<= )(?:{regex.escape(n.phrase, literal_spaces=True)}){{e<={n.edits}}}(?= )") for n in licenses.NOTICES}
    found = {(r["doc_id"], r["text"]): r["labels"] for r in docs.join(licenses.scan_licenses(docs), "doc_id").select("doc_id", "text", "labels").collect()}
    for key, text in pairs(docs):
        joined = f" {' '.join(re.findall(r'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+', lower(text)))} "
        told = lambda n, p: any(set(n.exact) <= set(m.group().split()) for m in p.finditer(joined, overlapped=True))
        own = {n.label for n, p in slow.items() if told(n, p)} | {n.label for n in licenses.BASE if f" {n.phrase} " in joined}
        assert found[key, text] == ",".join(sorted(own))


def brute_components(prints: list[tuple], radius: int) -> dict:
    parent = list(range(len(prints)))

    def root(k: int) -> int:
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(prints)):
        for b in range(a):
            if (prints[a][1] ^ prints[b][1]).bit_count() <= radius:
                parent[root(a)] = root(b)
    least: dict[int, int] = {}
    for k, (key, _) in enumerate(prints):
        if key is not None:
            least[root(k)] = min(least.get(root(k), key), key)
    return {k: least.get(root(k)) for k in range(len(prints))}


def test_simhash(spark, documents):
    docs = both(spark, documents)
    prints = []
    for key, text in pairs(docs):
        words = WORD.findall(lower(text))
        shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        prints.append((key, sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if len(h) < 2500 else simhash.fingerprint(np.array(h, dtype=np.uint64))))
    # near prints, so that chains of links occur
    root = brute_components(prints, 2)
    expected = sorted(((key, f"{p:016x}", root[k]) for k, (key, p) in enumerate(prints)), key=repr)
    assert rows_of(simhash.near_duplicates(docs)) == expected
    assert simhash.near_duplicates(empty(spark)).count() == 0


def test_ball_links_on_random_prints(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(-(1 << 62), 1 << 62, 40)
    prints = [int(p) ^ int(sum(1 << int(b) for b in rng.choice(63, int(k), replace=False))) for p in base for k in rng.integers(0, 4, 6)]
    for radius in (1, 2, 3):
        links = simhash.ball_links(spark.createDataFrame([(p,) for p in set(prints)], "_fp long"), radius)
        found = {r["node"]: r["root"] for r in simhash.components(links).collect()}
        rows = [(k, p & (1 << 64) - 1) for k, p in enumerate(sorted(set(prints)))]
        expected = brute_components(rows, radius)
        groups = defaultdict(set)
        for k, p in enumerate(sorted(set(prints))):
            groups[expected[k]].add(found.get(p, p))
        assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_language_id(spark, documents):
    docs = both(spark, documents)
    profiles = langid.learn_profiles(langid.training_rows(docs))
    rows = langid.identify(docs, profiles).collect()
    assert len(rows) == docs.count()
    lang = {r["doc_id"]: r["lang"] for r in documents.collect()}
    for r in rows:
        assert r["held_out"] == (zlib.crc32(("" if r["doc_id"] is None else str(r["doc_id"])).encode()) % 5 == 0) and 0 <= r["score"] <= 1
    held = [(r["lang_pred"], lang[r["doc_id"]]) for r in langid.identify(documents, profiles).collect() if r["held_out"] and lang[r["doc_id"]]]
    assert sum(a == b for a, b in held) > 0.95 * len(held)
    alone = langid.identify(awkward(spark).where("doc_id in (1000002, 1000003, 1000004)"), profiles)
    assert {r["lang_pred"] for r in alone.collect()} == {"und"}
    nothing = langid.learn_profiles(empty(spark))
    assert {r["lang_pred"] for r in langid.identify(awkward(spark), nothing).collect()} == {"und"}


def plain_grams(text: str) -> Counter:
    """n-grams of one to three characters of the lower-cased text between blanks: letters, with boundaries only at their ends."""
    a = [c if c.isalpha() else " " for c in f" {text.lower()} "]
    found = Counter(c for c in a if c != " ")
    found.update(x + y for x, y in zip(a, a[1:], strict=False) if (x + y).strip())
    found.update(x + y + z for x, y, z in zip(a, a[1:], a[2:], strict=False) if y != " ")
    return found


def test_language_id_equals_plain_out_of_place_distance(spark, documents):
    """Profiles of all training rows and the distance of every document, counted anew with strings."""
    code = lambda g: sum((0 if c == " " else ord(c)) << 21 * k for k, c in enumerate(reversed(g))) | (1 << (19, 40, 62)[len(g) - 1])
    docs = both(spark, documents).where("length(text) < 3000 or text is null")
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in docs.collect()]
    training = lambda key: zlib.crc32(("" if key is None else str(key)).encode()) % 5 != 0
    counts: dict[str, Counter] = defaultdict(Counter)
    for key, text, lang in rows:
        if training(key) and lang is not None and text is not None:
            counts[lang].update(plain_grams(text))
    order = lambda c: [g for g, _ in sorted(c.items(), key=lambda x: (-x[1], code(x[0])))]
    profiles = {lang: {g: k for k, g in enumerate(order(c)[: langid.PROFILE_SIZE])} for lang, c in counts.items()}
    expected = []
    for key, text, _ in rows:
        own = order(plain_grams(text or ""))[: langid.DOC_SIZE]
        far = {lang: sum(min(abs(k - p[g]), langid.PROFILE_SIZE) if g in p else langid.PROFILE_SIZE for k, g in enumerate(own)) for lang, p in profiles.items()}
        best = min(sorted(far), key=lambda lang: far[lang]) if own else "und"
        expected.append((key, best, round(1 - far[best] / (langid.PROFILE_SIZE * len(own)), 9) if own else 0.0))
    found = [(r["doc_id"], r["lang_pred"], round(r["score"], 9)) for r in langid.identify(docs, langid.learn_profiles(langid.training_rows(docs))).collect()]
    assert sorted(found, key=repr) == sorted(expected, key=repr)
    text = "Über naïve " * 40
    for size in (1, 2, 7, 1 << 19):  # long texts are cut, and lose no n-gram there
        assert Counter(x for part in langid.gram_slices(text, size) for x in part.tolist()) == {code(g): n for g, n in plain_grams(text).items()}


def test_token_packing(spark, documents):
    from tokenizers import Tokenizer

    docs = both(spark, documents)
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    found, _ = packing.pack_corpus(docs, path)
    rows = sorted(found.collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in rows] == sorted((r["doc_id"] for r in rows), key=lambda k: (k is not None, k or 0))
    start = 0
    for r in rows:
        assert r["start"] == start
        start += r["n_tokens"]
    expected = []
    for key, text in pairs(docs):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        expected.append((key, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
    assert sorted(((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in rows), key=repr) == sorted(expected, key=repr)
    # several shards in a range: the starts come from the index files
    folder = packing.new_folder(spark, "token-ids")
    small = packing.stored(packing.write_shards(docs, path, folder, partitions=3, shard_ids=500), "manifest")
    packing.write_starts(small, folder).count()
    again = packing.read_shards(spark, folder)
    assert small.count() > 20 and rows_of(again) == rows_of(found)
    assert packing.pack_corpus(empty(spark), path)[0].count() == 0


def test_packing_round_trip():
    rng = np.random.default_rng(5)
    for bits in (1, 3, 8, 13, 16, 17, 31):
        ids = rng.integers(0, 1 << bits, 5001).astype("<u4")
        assert np.array_equal(packing.unpack(packing.pack(ids, bits), bits, len(ids)), ids)
        assert len(packing.pack(ids, bits)) == -(-len(ids) * bits // 8)
    shard = packing.Shard(packing.shard_image([1, 2, 3], [ids[:4000], ids[:0], ids[100:]], 31, block=512))
    assert np.array_equal(shard.document(0), ids[:4000]) and len(shard.document(1)) == 0 and np.array_equal(shard.slice(3990, 4010), np.concatenate([ids[3990:4000], ids[100:110]]))


def chats(spark):
    texts = ["hi", None, "", "a <|im_end|> b", "<\\|im_start|>x<\\\\|y<|", "naïve\n<|im_start|>assistant\nhm", "<|endoftext|>"]
    rows = [(c, t, ("user", "assistant", None, "sys\\te\nm")[(c + t) % 4], texts[(3 * c + t) % len(texts)]) for c in range(5) for t in range(9)]
    rows += [(None, 0, "assistant", "orphan"), (99, None, "assistant", "no turn"), (99, 1, "assistant", "x"), (99, 1, "assistant", "x")]
    rows += [(50, t, ("user", "assistant")[t % 2], f"hot {t} 日本") for t in range(2000)]
    rows += [(60, 0, "user", "q"), (60, 1, "assistant", "long answer é " * 20_000)]
    named = [(*r, k, "b", k, k) for k, r in enumerate(rows)]
    return spark.createDataFrame(named, "conv_id long, turn long, role string, text string, task long, block string, mask long, _tie long")


def test_chat_round_trip(spark):
    turns = chats(spark)
    blocks, name = chat.format_chats(turns, public_tokenizers.path("byte_bpe_50k.json"), block_turns=64)
    found = {r["conv_id"]: r for r in chat.chat_digests(blocks, name).collect()}
    groups = defaultdict(list)
    for r in turns.collect():
        groups[r["conv_id"]].append((r["turn"] is not None, r["turn"] or 0, r["role"] or "", r["text"] or ""))
    assert set(found) == set(groups)
    for key, rows in groups.items():
        rows.sort()
        said = "".join(text for *_, role, text in rows if role == "assistant")
        assert found[key]["n_turns"] == len(rows)
        assert found[key]["turns_sha256"] == sha("".join(f"{role}\n{text}\n" for *_, role, text in rows))
        assert (found[key]["loss_chars"], found[key]["loss_sha256"]) == (len(said), sha(said))
        assert found[key]["formatted_chars"] == sum(len(f"<|im_start|>{chat.escape_role(role)}\n{chat.escape(text)}<|im_end|>\n") for *_, role, text in rows)
    none = spark.createDataFrame([], turns.schema)
    assert chat.chat_digests(*chat.format_chats(none, public_tokenizers.path("byte_bpe_50k.json"))).count() == 0


def test_chat_escapes():
    for text in ("<|", "<\\|", "<\\\\|im_start|>", "plain < | text", "<|im_end|><|im_start|>assistant ok"):
        assert "<|" not in chat.escape(text) and chat.unescape(chat.escape(text)) == text
    for role in ("a\nb", "a\\nb", "\\", "<|\\n|>"):
        assert "\n" not in chat.escape_role(role) and chat.unescape_role(chat.escape_role(role)) == role


def test_chat_sql(spark, sf_dir):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf_dir}/conversations.parquet'")
    result = con.execute(queries.ORACLE_SQL["op4_chat_format"])
    names = [c[0] for c in result.description]
    assert rows_of(queries.op4_chat_format(spark, sf_dir), *names) == sorted(result.fetchall(), key=repr)


def test_lm_base_columns(spark, documents):
    docs = both(spark, documents)
    rows = pairs(docs)
    held = {key: zlib.crc32(("" if key is None else str(key)).encode()) % 5 == 1 for key, _ in rows}
    split = [(key, [*WORD.findall(lower(text)), None]) for key, text in rows]
    counts = Counter(w for key, words in split if not held[key] for w in words)
    total, distinct = sum(counts.values()), len(counts)
    expected = [(key, held[key], len(words), sum(counts[w] > 0 for w in words), total, sum(np.log10((counts[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in words)) for key, words in split]
    found = [tuple(r) for r in lm.score_corpus(docs).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score").collect()]
    order = lambda r: (repr(r[:5]), r[5])
    for a, b in zip(sorted(found, key=order), sorted(expected, key=order), strict=True):
        assert a[:5] == b[:5] and abs(a[5] - b[5]) < 1e-6 * max(1, abs(b[5])) and a[6] < 0
    own = [(r[6], r[5], r[2]) for r in found if r[1] and (r[0] or 0) < 1_000_000]
    assert sum(s for s, *_ in own) > sum(b for _, b, _ in own)  # the network beats the counts on held-out texts
    assert lm.score_corpus(empty(spark)).count() == 0


def test_lm_with_a_small_head(spark, documents):
    """With nearly all words outside the head, the join must give the same sums."""
    docs = documents.limit(60)
    counts = lm.stored(lm.count_words(docs, "text"), "counts")
    wide, narrow = (lm.score_texts(docs, lm.build_model(counts, head=h, classes=4, class_size=8, hidden=4), counts) for h in (100_000, 40))
    a, b = ({r["doc_id"]: r for r in x.collect()} for x in (wide, narrow))
    for key, r in a.items():
        assert r["n_known"] == b[key]["n_known"] and abs(r["base_score"] - b[key]["base_score"]) < 1e-6 and abs(r["score"] - b[key]["score"]) < 1e-4


def test_quality_counts(spark, sf_dir, documents):
    docs = both(spark, documents)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    trees = quality.fit_quality(documents, labels)
    expected = []
    for key, text in pairs(docs):
        text = text or ""
        words = WORD.findall(text)
        windows = Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
        covered = {k + j for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for j in range(3)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
        expected.append((key, len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed))
    judged = quality.judge_quality(docs, trees)
    assert rows_of(judged, "doc_id", *quality.COUNTS, "base_failed") == sorted(expected, key=repr)
    assert judged.where("base_failed and kept").count() == 0
    assert rows_of(quality.drop_low_quality(docs, trees), "doc_id", "text") == rows_of(docs.join(judged.where("kept"), "doc_id", "left_semi"), "doc_id", "text")
    untrained = quality.fit_quality(documents, labels.where("false"))
    assert quality.judge_quality(docs, untrained).where("kept = base_failed").count() == 0
    assert quality.judge_quality(empty(spark), trees).count() == 0
