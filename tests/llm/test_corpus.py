"""Corpus operators against plain loops, on odd rows, on an empty table and on the small tables."""

from __future__ import annotations

import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import xxhash
from loops import plain_roots
from pyspark.sql import functions as F

duckdb = pytest.importorskip("duckdb")

from tillflow.llm import exact_dedup, html_text, language_id, mixing, piece_tokens, quality, sharding, simhash, simple8b, substring_dedup, token_files  # noqa: E402
from tillflow.llm.components import roots  # noqa: E402
from tillflow.llm.queries import ORACLES, QUERIES, tokenizer_file  # noqa: E402

WORD = re.compile(r"[^\x20\x09-\x0D]+")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
BYTES = public_tokenizers.path("byte_bpe_50k.json")


def held(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def got(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def ranked(rows):
    return sorted(rows, key=repr)


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_query_equals_its_sql(spark, sf, key):
    con = duckdb.connect()
    for name in ("documents", "embeddings"):
        con.execute(f"create view {name} as select * from read_parquet('{sf}/{name}.parquet')")
    df = QUERIES[key](spark, sf)
    columns = sorted(df.columns)
    result = con.sql(ORACLES[key])
    want = [tuple(dict(zip(result.columns, row))[c] for c in columns) for row in result.fetchall()]
    assert ranked(want) == got(df, *columns) and want


def test_pieces_are_the_librarys(odd, none):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    want = []
    for doc_id, text in held(odd):
        ids = library.encode(text or "")
        want.append((doc_id, len(ids), sha256(",".join(map(str, ids)).encode()).hexdigest(), sha256(library.decode(ids).encode()).hexdigest()))
    assert got(piece_tokens.digests(odd, PIECES), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == ranked(want)
    first = {r["doc_id"]: r for r in piece_tokens.encode(odd, PIECES).collect()}
    assert all(first[d]["ids"] == library.encode(t or "") and first[d]["decoded"] == library.decode(library.encode(t or "")) for d, t in held(odd) if d not in (7, 8, None))
    assert piece_tokens.digests(none, PIECES).count() == 0


def test_pieces_of_random_strings():
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    model, rng = piece_tokens.model_at(PIECES), random.Random(2)
    parts = [" ", "  ", "\n", "a", "the", "▁", "é", "日本", "\t", "xxxxx", "<s>", "\x00", "😀", "1", "\xa0", "ﬁ", "<0x0A>"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 12))) for _ in range(1500)]
    found = model.digests(texts)
    for text, digest in zip(texts, found):
        ids = library.encode(text)
        assert model.encode(text) == ids and digest[1] == sha256(",".join(map(str, ids)).encode()).hexdigest() and model.decode(ids) == library.decode(ids)


def test_pieces_take_bounded_memory(monkeypatch):
    library, rng = sentencepiece.SentencePieceProcessor(model_file=PIECES), random.Random(3)
    texts = [" ".join("".join(rng.choices("abcdefghij", k=rng.randint(1, 9))) for _ in range(40)) for _ in range(60)]
    tracemalloc.start()
    try:
        model = piece_tokens.PieceModel(PIECES)
        model.digests(texts)
        assert tracemalloc.get_traced_memory()[1] < 100_000_000
    finally:
        tracemalloc.stop()
    monkeypatch.setattr(piece_tokens, "MEMO_UNITS", 50)
    monkeypatch.setattr(piece_tokens, "KEPT_UNITS", 20)
    monkeypatch.setattr(piece_tokens, "MEMO_PAIRS", 100)
    for text in texts:
        ids = library.encode(text)
        assert model.encode(text) == ids and model.digests([text])[0][1] == sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert len(model.units) <= 50 + 40 and model.pairs.count <= 100 + 2000


def test_pair_memo_grows_and_keeps():
    memo, rng = piece_tokens.PairMemo(), random.Random(4)
    want = {rng.randrange(1 << 31): rng.random() < 0.5 for _ in range(100_000)} | {0: True}
    for key, yes in want.items():
        memo.add(memo.place(key), key, yes)
    keys = np.array(list(want), dtype=np.int64)
    held = memo.slots[memo.places(keys)]
    assert memo.count == len(want) and (held >> 1 == keys + 1).all() and [bool(h & 1) for h in held] == list(want.values())
    assert all(memo.view[memo.place(k)] == 2 * (k + 1) + yes for k, yes in list(want.items())[:1000])
    assert not memo.view[memo.place(1 << 32)] and memo.slots.nbytes <= 32 * len(want)


def test_quality_of_odd_rows(odd, none):
    def features(text):
        words = WORD.findall(text or "")
        windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
        counts, covered = Counter(windows), set()
        for i, w in enumerate(windows):
            if counts[w] > 1:
                covered.update(range(i, i + 5))
        lines = [x for x in (text or "").split("\n") if WORD.search(x)]
        return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)

    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    judged = quality.judge(odd)
    assert got(judged, "doc_id", *names) == ranked([(d, *features(t)) for d, t in held(odd)])
    assert all((r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"]) == r["base_failed"] and not (r["kept"] and r["base_failed"]) for r in judged.collect())
    kept = quality.keep(odd)
    assert kept.columns == odd.columns and got(kept, "doc_id", "text") == ranked([(r["doc_id"], t) for r, t in zip(*_paired(judged, odd)) if r["kept"]])
    assert quality.judge(none).count() == 0 and quality.keep(none).count() == 0


def _paired(judged, odd):
    verdicts = {(r["doc_id"], r["n_words"]): r for r in judged.collect()}
    rows = held(odd)
    return [verdicts[d, len(WORD.findall(t or ""))] for d, t in rows], [t for _, t in rows]


def test_quality_order_is_by_rejection_per_cost(odd):
    order = quality.ordered(odd)
    assert sorted(r.name for r in order) == sorted(r.name for r in quality.RULES)


def test_simple8b_round_trip():
    rng = np.random.default_rng(0)
    for _ in range(150):
        lengths = rng.integers(0, 150, rng.integers(0, 6))
        n = int(lengths.sum())
        ids = rng.integers(0, 2**63, n, dtype=np.uint64) >> rng.integers(0, 64, n).astype(np.uint64)
        ids[rng.random(n) < 0.1] |= np.uint64(1 << 63)
        words, per_stream = simple8b.pack(ids, lengths)
        assert (simple8b.unpack(words) == ids).all() and per_stream.sum() == len(words)
        at = first = 0
        for n_ids, n_words in zip(lengths, per_stream):
            assert (simple8b.unpack(words[at : at + n_words]) == ids[first : first + n_ids]).all()
            at, first = at + n_words, first + n_ids


def test_token_files(spark, odd, none, tmp_path):
    from tokenizers import Tokenizer

    library, want, start = Tokenizer.from_file(BYTES), [], 0
    path = str(tmp_path / "files")
    token_files.write(odd, BYTES, 2, path, block_ids=500)
    rows = sorted((tuple(r) for r in token_files.read(spark, path).collect()), key=lambda r: r[1])
    texts = defaultdict(list)
    for d, t in held(odd):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], dtype="<u4")
        texts[d].append((len(ids), zlib.crc32(ids.tobytes())))
    assert [r[0] for r in rows] == sorted((d for d, _ in held(odd)), key=lambda d: (d is not None, d or 0))
    for d, s, n, crc in rows:
        assert s == start and (n, crc) in texts[d]
        start += n
    blocks = [r.asDict() for r in spark.read.parquet(path).collect()]
    for block in blocks[:5]:
        docs, counts, ids = token_files.decode_block(block)
        assert len(docs) == len(counts) == block["n_docs"] and (token_files.decode_document(block, len(docs) - 1) == ids[len(ids) - counts[-1] :]).all()
    assert token_files.write_and_read(none, BYTES).count() == 0


def test_words_are_asked_for_once_with_and_without_signs(monkeypatch):
    """Signs behind a word make no new unit, ids stay those of the library, and a full memo keeps its first units."""
    tokenizer, asked = token_files.UnitTokenizer(BYTES), []
    units = tokenizer.units
    monkeypatch.setattr(tokenizer, "units", lambda u: units(asked.extend(u) or u))
    texts = ["word and word, word. (word) word!?! word's word'. 12. 12 wörd, wörd ﬁ. 中. ª, ²,", "word; and# Word. x.y, don't, don't.\nword,\nword", "word,,,,,, .. ,word e\u0301. _a. a_."]
    assert tokenizer.encode(texts) == tokenizer.whole(texts)
    assert [u.strip() for u in asked].count("word") == 2 and not [u for u in asked if u in (" word,", " word.", " word!?!", " wörd,", " and#")]
    monkeypatch.setattr(token_files, "MEMO_UNITS", 4)
    monkeypatch.setattr(token_files, "KEPT_UNITS", 2)
    first = list(tokenizer.memo)[:2]
    assert tokenizer.encode(texts[1:]) == tokenizer.whole(texts[1:])
    assert list(tokenizer.memo)[:2] == first
    assert tokenizer.encode(texts) == tokenizer.whole(texts)


def test_units_of_random_strings():
    tokenizer, rng = token_files.tokenizer_at(BYTES), random.Random(1)
    parts = [" ", "  ", "\n", "a", "the", "é", "日本", "\t", "'s", "don't", "1", "22", "\r\n", "\xa0", ".", "!!", "<|endoftext|>", "\x1c", "　", "\x85"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 9))) for _ in range(3000)]
    assert tokenizer.encode(texts) == tokenizer.whole(texts)


def test_sharding(spark, sf, odd, none):
    placed, table = sharding.shard(odd, 5)
    rows = placed.collect()
    assert len(rows) == odd.count() and none.count() == sharding.shard(none, 5)[0].count()
    for s in {r["shard"] for r in rows}:
        own = sorted(r["position"] for r in rows if r["shard"] == s)
        assert own == list(range(len(own)))
    assert ranked([(r["id"], r["bytes"], r["crc"]) for r in rows]) == ranked([(d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t in held(odd)])
    result = QUERIES["op4_sharding"](spark, sf).collect()
    loads = Counter()
    for r in result:
        loads[r["shard"]] += r["size"]
    assert len(loads) == 24 and max(loads.values()) - min(loads.values()) <= max(r["size"] for r in result)
    grown = sharding.rebalance(table, 6).collect()
    before = {(r["vslot"], r["part"]): r["shard"] for r in table.collect()}
    assert {(r["vslot"], r["part"]) for r in grown} == set(before) and {r["version"] for r in grown} == {2}
    assert all(r["shard"] == before[r["vslot"], r["part"]] for r in grown if r["shard"] < 5 and r["bytes"] > sum(x["bytes"] for x in grown) / 6)


def test_sharding_splits_a_hot_text(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'the same text in a third of all rows' ELSE concat('text ', id) END AS text")
    loads = Counter()
    for r in sharding.shard(docs, 8)[0].collect():
        loads[r["shard"]] += r["bytes"]
    assert max(loads.values()) < 1.02 * min(loads.values())


def test_language(spark, sf, odd, none):
    found = QUERIES["op5_language_id"](spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held_out = [r for r in found if r["held_out"]]
    assert {r["doc_id"] for r in held_out} == {r["doc_id"] for r in found if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2}
    assert sum(r["lang_pred"] == r["lang"] for r in held_out) >= 0.9 * len(held_out) and all(0 <= r["score"] <= 1 for r in found)
    rows = language_id.identify(odd).collect()
    und = {d for d, t in held(odd) if not any(c.isalpha() for c in t or "")}
    assert len(rows) == odd.count() and {r["doc_id"] for r in rows if r["lang_pred"] == "und"} == und
    assert language_id.identify(none).count() == 0


def test_language_gradient():
    network = language_id.Network.fresh(["a", "b"])
    network.weights = {k: v.astype(np.float64) for k, v in network.weights.items()}
    words, labels = [b"hello", b"ab", b"xyzzy"], np.array([0, 1, 1])

    def loss():
        p = 0.0
        for w, k in zip(words, labels):
            matrix, sizes = language_id._matrix([w])
            f = network.states(matrix, "f")[0].astype(float) @ network.weights["of"]
            b = network.states(language_id._reversed(matrix, sizes), "b")[0].astype(float)[::-1] @ network.weights["ob"]
            x = f + b + network.weights["bo"]
            p -= (x[:, 0, k] - np.log(np.exp(x[:, 0]).sum(axis=1))).sum()
        return p / sum(len(w) + 2 for w in words)

    grads = network.gradient(words, labels)
    for key, place in (("uf", (1, 2)), ("vb", (3, 4)), ("e", (ord("y"), 1)), ("ob", (2, 1)), ("wf", (1, 5))):
        kept = network.weights[key][place]
        network.weights[key][place] = kept + 1e-2
        high = loss()
        network.weights[key][place] = kept - 1e-2
        low = loss()
        network.weights[key][place] = kept
        assert abs((high - low) / 2e-2 - grads[key][place]) < 1e-4


def test_substrings(odd, none):
    texts = [(d if d is not None else 2**62, d, WORD.findall(t or "")) for d, t in held(odd)]
    least = {}
    for d, _, w in texts:
        for i in range(len(w) - 12):
            key = tuple(w[i : i + 13])
            least[key] = min(d, least.get(key, d))
    want = []
    for d, given, w in texts:
        gone = {j for i in range(len(w) - 12) if least[tuple(w[i : i + 13])] < d for j in range(i, i + 13)}
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        want.append((given, len(w), len(gone), kept, sha256(kept.encode()).hexdigest()))
    found = substring_dedup.dedup(odd)
    assert got(found, "doc_id", "n_words", "n_removed", "kept_text", "kept_sha256") == ranked(want) and any(x[2] for x in want)
    assert substring_dedup.dedup(none).count() == 0


def test_substrings_keep_large_ids_beside_a_null_id(spark):
    words = [f"w{i}" for i in range(30)]
    text, big = " ".join(words), 2**53
    rows = [(None, text), (big + 1, text), (big + 3, "x " + text), (5, None), (None, "a b")]
    found = got(substring_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(1)), "doc_id", "n_words", "n_removed")
    assert found == ranked([(None, 30, 30), (big + 1, 30, 0), (big + 3, 31, 30), (5, 0, 0), (None, 2, 0)])


def test_html(spark):
    page = "<html><body><nav><a>Menu {i}</a></nav><div class='ad'>Buy {i}</div><article><h1>Title {i} &amp; more</h1><p>Read our terms.</p><p><b>Text {i}<br>goes\n on<p>End {i}</p>{more}<section class='comments'><p>me {i}</p></section></article><footer>foot</footer></body></html>"
    rows = [(i, f"https://a.example/{i}", page.format(i=i, more="<p>extra</p>" * (i % 3))) for i in range(9)]
    rows += [(20, None, None), (21, "https://b.example/", ""), (22, "no url", "plain <i>text</i> &lt;x"), (None, "https://a.example/z", "<p>cut <"), (23, "https://c.example", "<p>" + "<div>" * 3000 + "deep")]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, host string")
    found = {(r["page_id"], r["url"]): r for r in html_text.extract(pages).collect()}
    assert len(found) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in found.values())
    for i in range(9):
        # "Read our terms." stands on every page of the host and is template; "extra" is on two thirds of them.
        assert found[i, f"https://a.example/{i}"]["text"].startswith(f"Title {i} & more\n\nText {i} goes on\n\nEnd {i}")
    assert found[20, None]["text"] == "" and found[21, "https://b.example/"]["text"] == "" and found[22, "no url"]["text"] == "plain text <x" and found[23, "https://c.example"]["text"] == "deep"
    assert html_text.extract(pages.where("page_id > 99")).count() == 0


def test_html_query_keeps_the_articles(spark, sf):
    found = QUERIES["op7_html_text"](spark, sf).collect()
    source = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    from html import unescape

    for r in found:
        article = source[r["page_id"]].split("<article>", 1)[1].split("</article>")[0]
        parts = [" ".join(unescape(re.sub("<[^>]*>", "", p.replace("<br>", " "))).split()) for p in re.split("</?(?:p|h1)>", article)]
        assert r["text"] == "\n\n".join(p for p in parts if p)


def test_mixing(odd, none):
    rows = mixing.mix(odd).collect()
    texts = held(odd)
    assert ranked([(r["doc_id"], r["size"]) for r in rows]) == ranked([(d, len(WORD.findall(t or ""))) for d, t in texts])
    assert all(r["taken"] in (0, r["size"], 2 * r["size"]) for r in rows)
    taken, largest, target, total = Counter(), Counter(), {}, 0
    for r in rows:
        key = r["source_size"]
        taken[key] += r["taken"]
        largest[key] = max(largest[key], r["size"])
        target[key] = r["target"]
        assert r["target"] <= 2 * r["source_size"] + 1e-9
        total += r["size"]
    assert abs(sum(target.values()) - 1.5 * total) < 1e-6 and all(abs(taken[k] - target[k]) <= largest[k] for k in target)
    assert got(mixing.mix(odd), *rows[0].__fields__) == got(mixing.mix(odd.repartition(5)), *rows[0].__fields__)
    mixed = mixing.mixed_rows(odd)
    per_row = Counter()
    for r in rows:
        per_row[r["doc_id"], r["size"]] += r["copies"]
    assert mixed.columns == odd.columns and Counter((d, len(WORD.findall(t or ""))) for d, t in held(mixed)) == +per_row
    assert mixing.mix(none).count() == 0 and mixing.mixed_rows(none).count() == 0


def test_mixing_chances_are_unequal_and_decide(spark):
    """Inclusion rates fit the chances, and order by u alone would take other documents."""
    size = F.expr("cast(pow(2, id % 8) as int)")
    docs = spark.range(24_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 11 == 0, "a").when(F.col("id") % 3 == 0, "b").otherwise("c").alias("source"), F.repeat(F.lit("w "), size).alias("text"))
    docs = docs.withColumn("__copy", F.lit("mine")).withColumn("row", F.lit(2))
    share = dict(weights=(1, 3, 3), total=0.9)
    _, decided = mixing.plan(docs, "doc_id", "text", "source", (1, 3, 3), 0.9, 2, "mix-1")
    chance = {(r["source"], r["bits"]): (r["whole"], r["p"], r["source_size"], r["target"]) for r in decided.collect()}
    rows = [(r["source"], r["doc_id"], r["size"], r["copies"]) for r in mixing.mix(docs, **share).join(docs.select("doc_id", "source"), "doc_id").collect()]
    held, extra, words = Counter(), Counter(), Counter()
    for source, _, n, copies in rows:
        key = source, n.bit_length()
        held[key] += 1
        extra[key] += copies - chance[key][0]
        words[source] += copies * n
    assert max(abs(extra[k] / held[k] - chance[k][1]) * held[k] ** 0.5 for k in held) < 2.5
    assert len({p for _, p, _, _ in chance.values() if 0 < p < 1}) > 16
    for (source, bits), (whole, p, total, target) in chance.items():
        assert abs(words[source] - target) <= 128 and (p in (0, 1) or 0 < p < 1)
        tops = [q for (s, _), (_, q, _, _) in chance.items() if s == source and 0 < q < 1]
        assert not 0 < p < 1 or abs(p / bits - min(tops) / min(b for (s, b), (_, q, _, _) in chance.items() if s == source and q == min(tops))) < 1e-9
    ranked_by_u = {r["doc_id"]: r["u"] for r in docs.select("doc_id", mixing.chance(F.col("doc_id")).alias("u")).collect()}
    taken = [ranked_by_u[d] for s, d, n, c in rows if s == "c" and 0 < chance[s, n.bit_length()][1] < 1 and c > chance[s, n.bit_length()][0]]
    left = [ranked_by_u[d] for s, d, n, c in rows if s == "c" and 0 < chance[s, n.bit_length()][1] < 1 and c == chance[s, n.bit_length()][0]]
    assert max(taken) > min(left) + 0.05
    other = {r["doc_id"]: r["copies"] for r in mixing.mix(docs, **share, seed="mix-2").collect()}
    assert sum(other[d] != c for _, d, _, c in rows) > 1000
    mixed = mixing.mixed_rows(docs, **share)
    assert mixed.columns == docs.columns and mixed.count() == sum(c for *_, c in rows) and {tuple(r) for r in mixed.select("__copy", "row").distinct().collect()} == {("mine", 2)}


def plain_fingerprint(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("hot", [24, 1])
def test_simhash(odd, none, hot, monkeypatch):
    monkeypatch.setattr(simhash, "HOT", hot)
    rows = [(d, plain_fingerprint(t)) for d, t in held(odd)]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (_, a) in enumerate(rows):
        for j, (_, b) in enumerate(rows[:i]):
            if (a ^ b).bit_count() <= 2:
                root[find(i)] = find(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        least[find(i)].append(d)
    want = [(d, f"{f:016x}", min((x for x in least[find(i)] if x is not None), default=None)) for i, (d, f) in enumerate(rows)]
    assert got(simhash.components(odd), "doc_id", "fingerprint", "component_id") == ranked(want)
    if hot > 1:
        kept = simhash.drop_near_copies(odd)
        assert kept.columns == odd.columns and {d for d, _ in held(kept)} == {c for _, _, c in want}
        assert kept.count() == len({find(i) for i in range(len(rows))})
        assert simhash.components(none).count() == 0 and simhash.drop_near_copies(none).count() == 0


def test_one_row_of_each_component_stays(spark):
    a, b, c = "one two three four", "five six seven eight", "nine ten eleven twelve"
    # Equal ids with other texts, equal rows, and components whose ids are all NULL.
    rows = [(5, a), (5, a), (5, b), (3, b.upper()), (3, b.upper()), (None, c), (None, c), (None, c.title()), (None, a)]
    kept = simhash.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    found = held(kept)
    assert len(found) == 3 and (5, a) in found and (3, b.upper()) in found and sum(d is None and t.lower() == c for d, t in found) == 1


@pytest.mark.parametrize("hot", [24, 2])
def test_links_of_close_fingerprints(spark, hot, monkeypatch):
    monkeypatch.setattr(simhash, "HOT", hot)
    rng = random.Random(3)
    prints = set()
    for _ in range(12):
        base = rng.getrandbits(64)
        for _ in range(15):
            prints.add(base)
            base ^= (1 << rng.randrange(64)) | (1 << rng.randrange(64)) if rng.random() < 0.8 else 0b10101
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    found = roots(simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long"))).collect()
    label = {r["a"]: r["b"] for r in found}
    root = {p: p for p in signed}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for a in signed:
        for b in signed:
            if ((a ^ b) & (2**64 - 1)).bit_count() <= 2 and find(a) != find(b):
                root[max(find(a), find(b))] = min(find(a), find(b))
    assert {p: label.get(p, p) for p in signed} == {p: find(p) for p in signed}


def test_exact(odd, none):
    groups = defaultdict(list)
    for d, t in held(odd):
        groups[t or ""].append(d)
    rows = exact_dedup.label(odd).collect()
    largest = {sha256(t.encode()).hexdigest(): max((d for d in ids if d is not None), default=None) for t, ids in groups.items()}
    sizes = {sha256(t.encode()).hexdigest(): len(ids) for t, ids in groups.items()}
    assert len(rows) == odd.count() and all(r["keep_id"] == largest[r["text_sha256"]] and r["group_size"] == sizes[r["text_sha256"]] for r in rows)
    assert Counter(r["text_sha256"] for r in rows if r["kept"]) == Counter(dict.fromkeys(largest, 1)) and all(r["doc_id"] == r["keep_id"] for r in rows if r["kept"])
    left = exact_dedup.drop_duplicates(odd)
    assert left.columns == odd.columns and ranked((d, t or "") for d, t in held(left)) == ranked((max((d for d in ids if d is not None), default=None), t) for t, ids in groups.items())
    assert exact_dedup.label(none).count() == 0 and exact_dedup.drop_duplicates(none).count() == 0


def test_filters_hold_their_keys():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 7, 100, 5000, 60_000):
        keys = rng.integers(0, 2**64, n, dtype=np.uint64)
        built = exact_dedup.build_filter(keys)
        assert exact_dedup.screen(keys, *built).all()
        assert exact_dedup.screen(rng.integers(0, 2**64, 20_000, dtype=np.uint64), *built).mean() < 0.01 or n < 100


def test_pipeline(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [r.asDict() for r in docs.collect()]
    result = got(corpus_pipeline.run(spark, sf), "doc_id", "n_tokens", "ids_sha256")
    verdicts = {r["doc_id"]: r["kept"] for r in quality.judge(docs).collect()}
    rows = [r for r in rows if verdicts[r["doc_id"]]]
    last = {r["text"]: r["doc_id"] for r in sorted(rows, key=lambda r: r["doc_id"])}
    rows = sorted((r for r in rows if last[r["text"]] == r["doc_id"]), key=lambda r: r["doc_id"])
    root = plain_roots([r["text"] for r in rows])
    rows = [r for i, r in enumerate(rows) if root[i] == i]
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(spark.createDataFrame(rows, docs.schema)).collect()}
    library = sentencepiece.SentencePieceProcessor(model_file=tokenizer_file("piece_bpe_32k.model"))
    want = []
    for r in rows:
        ids = library.encode(r["text"])
        want += [(r["doc_id"], len(ids), sha256(",".join(map(str, ids)).encode()).hexdigest())] * copies[r["doc_id"]]
    assert result == ranked(want) and len({d for d, _, _ in want}) > 20
