"""Each operator against brute force, and on odd tables."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import language_model, line_quality, minhash, mixing, packing, personal_data, simhash, substring_dedup, token_files, tokens, toxicity

LOW = bytes(range(256)).lower()


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) for _ in range(n))


def words(t):
    return (t or "").encode().split()


def ids_of(t):
    k = tokens.tokenizer(tokens.vocabulary_path())
    return np.array(k.encode(t or "", add_special_tokens=False).ids + [0], "<u4")


OPERATORS = {
    "lines": line_quality.clean_lines, "simhash": simhash.near_duplicates, "personal": personal_data.personal_spans, "repeats": substring_dedup.remove_repeats,
    "minhash": minhash.fingerprints, "files": token_files.round_trip, "toxicity": lambda d: toxicity.score_toxicity(d, toxicity.Lexicon()), "packing": packing.pack, "model": language_model.score,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_and_odd_tables(name, empty, odd):
    assert OPERATORS[name](empty).count() == 0
    got = OPERATORS[name](odd).collect()
    assert Counter(r.doc_id for r in got) == {5: 3, None: 2}


def test_line_quality(rows, docs):
    got = {r.doc_id: r for r in line_quality.clean_lines(docs).collect()}
    for r in rows:
        w, g = words(r[1]), got[r[0]]
        tri = list(zip(w, w[1:], w[2:]))
        many = {t for t, c in Counter(tri).items() if c > 1}
        covered = {i + k for i, t in enumerate(tri) if t in many for k in range(3)}
        assert (g.n_words, g.n_repeat_words, g.word_chars) == (len(w), len(covered), sum(len(x.decode()) for x in w))
        assert g.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w))
    assert got[138].n_dup_lines == 1 and got[130].kept is False
    assert all(got[r[0]].kept for r in rows if len(words(r[1])) > 60 and r[0] != 136)
    junk = "\n".join(["Buy*** now$$$ this### thing%%% here&&& all*** day$$$"] * 3 + ["home | about | contact | help | login"] * 9)
    assert line_quality.judge(junk.encode(), line_quality.LineRules())[6] is False


def test_simhash_components(rows, docs):
    fp = {r[0]: simhash.fingerprint_of((r[1] or "").encode()) for r in rows}
    root = {i: i for i in fp}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in fp:
        for j in fp:
            if i < j and (fp[i] ^ fp[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    for crowd in (1, 512):
        got = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs, crowd=crowd).collect()}
        assert got == {i: find(i) for i in fp}
    kept = {r.doc_id for r in simhash.keep_one_of_each(docs).collect()}
    assert kept == {find(i) for i in fp}


def test_personal_data():
    for text, base, more in (
        ("a@b@c.d.e", "email:2:9", ""), ("1.2.3.256 1.2.3.4.5", "ip:10:17", ""), ("é 4111 1111 1111 1111.", "card:2:21", ""), ("+1 (988) 555-2485", "phone:0:17", ""),
        ("mail jo.81 at mail7 dot example dot com now", "", "email:5:39"), ("ｊｏ＠mail．com", "", "email:0:11"), ("x (at) y [dot] com", "", "email:0:18"),
        ("call plus one two three four five five five one two three four", "", "phone:5:62"), ("the one and the three at home", "", ""), ("", "", ""), ("9" * 5000 + ".1.1.1", "", ""),
        ("call +1 555 123 four five six. thanks", "", "phone:5:29"), ("x jo&#64;mail&period;com y", "", "email:2:24"), ("available at example.com today", "", ""), ("(a.b) [c] <d>", "", ""),
        ("one-nine-two dot one-six-eight dot zero dot seven", "", "ip:0:49"),
    ):
        found, added = personal_data.find_spans(text)
        assert (personal_data.written_spans(found), personal_data.written_spans(added)) == (base, more)
    plain = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    for text in ("@@a@b.c@d.e", "a@b.c.@x.y z%@q-.r", "..@a.b"):
        assert personal_data.emails(text) == [m.span() for m in plain.finditer(text)]


def test_personal_data_on_tables(spark, docs):
    """Base spans, counts and digests against plain patterns; masking keeps rows, nulls and other columns."""
    rng = __import__("random").Random(2)
    pieces = ["a.b@c.org", "x@y", "1.2.3.4", "300.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "5500005555555559", "+44 20 7946 0958", "+1", "+1 (2", "é", "word", " ", "@", ".", "+", "\n", "12"]
    own = [(i, "".join(rng.choice(pieces) for _ in range(rng.randrange(0, 25)))) for i in range(400)]
    table = spark.createDataFrame(own, "doc_id long, text string").unionByName(docs.select("doc_id", "text"))
    plain = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def luhn(d):
        return sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0

    def fits(kind, m):
        d = re.sub("[^0-9]", "", m)
        return kind == "email" or kind == "ip" and all(int(p) <= 255 for p in m.split(".")) or kind == "card" and 16 <= len(d) <= 19 and luhn(d) or kind == "phone" and 8 <= len(d) <= 15

    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    rows = personal_data.personal_spans(table).collect()
    assert len(rows) == table.count()
    seen = Counter()
    for r in rows:
        options = [t or "" for t in ([own[r.doc_id][1]] if r.doc_id < 400 else []) + ([texts[r.doc_id]] if r.doc_id in texts else [])]
        wants = []
        for t in options:
            found = {k: [m.span() for m in re.finditer(p, t) if fits(k, m[0])] for k, p in plain.items()}
            wants.append((*(len(found[k]) for k in plain), hashlib.sha256(",".join(f"{k}:{a}:{b}" for k in plain for a, b in found[k]).encode()).hexdigest()))
        got = (r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256)
        assert got in wants
        seen.update(k for k, n in zip(plain, got) if n)
    assert min(seen[k] for k in plain) > 10
    masked = personal_data.mask_personal_data(docs)
    assert masked.columns == docs.columns and {r.doc_id for r in masked.where("text is null").collect()} == {130, 133} and masked.count() == docs.count()


def test_repeats(rows, docs):
    seen, want = set(), {}
    for r in sorted(rows):
        w = words(r[1])
        cut = [False] * len(w)
        for s in range(len(w) - 19):
            key = tuple(w[s : s + 20])
            if key in seen:
                cut[s : s + 20] = [True] * 20
            seen.add(key)
        want[r[0]] = (len(w), sum(cut), hashlib.sha256(b" ".join(x for x, c in zip(w, cut) if not c)).hexdigest())
    for batches in (1, 3):
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.remove_repeats(docs, batches).collect()}
        assert got == want
    assert sum(x[1] for x in want.values()) > 200


def test_repeats_side_by_side(spark):
    """Equal windows whose least hashes follow each other: a text of one period, copies in a row, the end of one text as the start of the next."""
    p = [f"p{i}" for i in range(24)]
    texts = [["a"] * 50, ["b", "c", "d"] * 20, p[:13] * 5, p[:20], p[:20], [x.upper() for x in p], [x.upper() for x in p], [f"q{i}" for i in range(30)], [f"q{i}" for i in range(10, 30)] + p[:5], ["e"] * 20, ["e"] * 21, ["f"] * 20]
    seen, want = set(), {}
    for i, w in enumerate(texts):
        cut = [False] * len(w)
        for s in range(len(w) - 19):
            key = tuple(w[s : s + 20])
            if key in seen:
                cut[s : s + 20] = [True] * 20
            seen.add(key)
        want[i] = (sum(cut), hashlib.sha256(" ".join(x for x, c in zip(w, cut) if not c).encode()).hexdigest())
    assert [want[i][0] for i in (0, 1, 2, 4, 6, 8, 9, 10, 11)] == [49, 57, 52, 20, 24, 20, 0, 21, 0]
    table = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string").coalesce(1)
    for batches in (1, 2):
        assert {r.doc_id: (r.n_removed, r.kept_sha256) for r in substring_dedup.remove_repeats(table, batches).collect()} == want
    assert sorted(r.n_removed for i in (0, 1, 2) for r in substring_dedup.remove_repeats(table.where(F.col("doc_id") == i), 1).collect()) == [49, 52, 57]


def test_window_index_takes_batches_apart(spark, rows, docs, tmp_path):
    """Batches added by separate objects, compacted on the way, equal brute force; batches without a match are not read."""
    import shutil

    path, seen, parts = str(tmp_path / "index"), set(), [(0, 99), (100, 119), (120, 129), (130, 200)]
    plain = spark.createDataFrame([(1000 + i, " ".join(f"own{i}w{k}" for k in range(60))) for i in range(5)], "doc_id long, text string")
    assert {r.n_removed for r in substring_dedup.WindowIndex(spark, path, fan=3).add(plain).collect()} == {0}
    shutil.rmtree(f"{path}/blocks/0")
    for k, (low, high) in enumerate(parts):
        index = substring_dedup.WindowIndex(spark, path, fan=3)
        got = {r.doc_id: r for r in index.add(docs.where(F.col("doc_id").between(low, high)), with_text=True).collect()}
        for r in sorted(r for r in rows if low <= r[0] <= high):
            w = words(r[1])
            cut = [False] * len(w)
            for s in range(len(w) - 19):
                key = tuple(w[s : s + 20])
                if key in seen:
                    cut[s : s + 20] = [True] * 20
                seen.add(key)
            kept = b" ".join(x for x, c in zip(w, cut) if not c)
            assert (got[r[0]].n_words, got[r[0]].n_removed, got[r[0]].kept.encode()) == (len(w), sum(cut), kept)
            assert got[r[0]].kept_sha256 == hashlib.sha256(kept).hexdigest()
        assert len(index.runs()) < 3
    assert index.runs()[0][:2] != (0, 0)


def test_repeats_in_very_long_texts(spark):
    """A text of megabytes, a word longer than what is hashed at once, a repeated passage at both ends."""
    passage = " ".join(f"p{i}" for i in range(25))
    long = f"{passage} " + " ".join(f"w{i}" for i in range(400_000)) + f" {'x' * 1_200_000} {passage}"
    got = {r.doc_id: (r.n_words, r.n_removed) for r in substring_dedup.remove_repeats(spark.createDataFrame([(1, long), (2, passage), (3, "y" * 700_000)], "doc_id long, text string")).collect()}
    assert got == {1: (400_051, 25), 2: (25, 25), 3: (1, 0)}


def test_minhash(rows, docs):
    got = {r.doc_id: r for r in minhash.fingerprints(docs).collect()}
    order = sorted(rows)

    def shingles(t):
        w = words(t)
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    errors = []
    for r, nxt in zip(order, order[1:] + order[:1]):
        t, n = r[1] or "", nxt[1] or ""
        k = len(t) // 4
        edited, g = t[: len(t) - k] + n[:k], got[r[0]]
        assert g.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and g.n_chars == len(t)
        a, b = shingles(t), shingles(edited)
        errors.append(g.near_edited - (1.0 if a == b else len(a & b) / len(a | b)))
    assert abs(np.mean(errors)) < 0.03 and np.max(np.abs(errors)) < 0.2
    assert len({got[100 + i].fingerprint for i in range(6)}) == 1 and got[130].fingerprint == got[131].fingerprint


def test_token_files(rows, docs, tmp_path):
    start = 0
    got = {r.doc_id: r for r in token_files.round_trip(docs).collect()}
    for r in sorted(rows):
        ids, g = ids_of(r[1]), got[r[0]]
        assert (g.start, g.n_tokens, g.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    path = f"{tmp_path}/files"
    token_files.write_token_files(docs, path)
    again = {r.doc_id: r.ids_crc32 for r in token_files.read_token_files(docs.sparkSession.newSession(), path, token_files.crc32_of).collect()}
    assert again == {i: r.ids_crc32 for i, r in got.items()}
    ranks = np.array([0, 255, 256, 65535, 65536, 1 << 24, (1 << 32) - 1, 7], np.uint32)
    assert (token_files.unpack_ranks(*token_files.pack_ranks(ranks), len(ranks)) == ranks).all()


def test_packing(rows, docs):
    got = packing.pack(docs, windows=2).collect()
    for r in rows:
        ids, own = ids_of(r[1]), sorted((p.start, p.length, p.ids_crc32) for p in got if p.doc_id == r[0])
        at = 0
        for start, length, crc in own:
            assert start == at and crc == zlib.crc32(ids[start : start + length].tobytes())
            at += length
        assert at == len(ids)
    windows = {}
    for p in got:
        windows.setdefault(p.sequence_id, []).append((p.offset, p.length))
    sizes = []
    for k in sorted(windows):
        at = 0
        for offset, length in sorted(windows[k]):
            assert offset == at
            at += length
        sizes.append(at)
    assert set(sizes[:-1]) == {1024} and sizes[-1] <= 1024


def test_packing_holds_targets(spark):
    """Explicit weights hold from the first window on until a source runs dry; sources without one come last."""
    rng = __import__("random").Random(4)
    docs = spark.createDataFrame([(i, prose(rng, 60), "abc"[i % 3]) for i in range(600)], "doc_id long, text string, source string")
    got = packing.pack(docs, {"a": 3.0, "b": 1.0}, windows=4).collect()
    by = Counter()
    for p in got:
        by[p.sequence_id // 4, p.source] += p.length
    total = Counter()
    for (part, source), n in by.items():
        total[source] += n
    dry = total["a"] / 3072  # parts of 4096 tokens, three quarters of them a's
    assert all(abs(by[k, "a"] - 3072) <= 2 and abs(by[k, "b"] - 1024) <= 2 and by[k, "c"] == 0 for k in range(int(dry)))
    last = max(k for k, s in by if s == "b")
    assert all(by[k, "c"] == 0 for k in range(last)) and sum(n for (k, s), n in by.items() if s == "c") == total["c"] > 0
    windows = Counter()
    for p in got:
        if p.sequence_id < 4 * int(dry):
            windows[p.sequence_id, p.source] += p.length
    assert max(abs(windows[k, "a"] - 768) for k in range(4 * int(dry))) <= 512


def test_encoding_of_odd_texts():
    """The ids of joined parts are those of whole texts, for all kinds of white space, punctuation and letters."""
    import pyarrow as pa

    rng = __import__("random").Random(1)
    alphabet = [" ", "  ", " ", " ", "a", "é", "b'", "'s", "1", "12", ".", "!?", "\n", "\t", "日", "　", "«", "\x1c", "\u0085", "“x”", "ß", "–", "😀", "\0", ", ", "×", "œ"]
    odd = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 30))) for _ in range(20_000)]
    path = tokens.vocabulary_path()
    got = [x for _, own in tokens.encoded([pa.RecordBatch.from_arrays([pa.array(odd)], ["text"])], path) for x in own]
    want = tokens.tokenizer(path).encode_batch_fast(odd, add_special_tokens=False)
    assert len(got) == len(odd) and all(g.tolist() == [*e.ids, 0] for g, e in zip(got, want))


def test_language_model(rows, docs, spark):
    from pyspark.sql import functions as F

    train = F.col("doc_id") % 4 != 0
    tok = lambda t: [*(t or "").encode().translate(LOW).split(), b" end"]
    c = Counter(x for r in rows if r[0] % 4 for x in tok(r[1]))
    n, v = sum(c.values()), len(c)
    for r in language_model.score(docs, train).collect():
        t = tok(next(x[1] for x in rows if x[0] == r.doc_id))
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(t), sum(c[x] > 0 for x in t), n)
        assert abs(r.base_score - sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in t)) < 1e-6 and r.score <= 0


def test_toxicity_grammar():
    lexicon = toxicity.Lexicon({"zorb": 1.0})
    e = lambda t: toxicity.evidence(t, lexicon, lexicon.signs())
    assert e("a calm line") == 0 == e("")
    assert e("you idiot") > e("idiot") > e("not an idiot") > 0
    assert e("he said idiot") < e("they idiot") and e("zorbling here") == e("idiot here")
    assert e("idiot, all of you") == e("you idiot") and e("I will kill you") > 10 * e("kill the process") > 0
    score = lambda t: toxicity.score_of(e(t), lexicon)
    assert score("you idiot") > 0.5 and score("I will kill you") > 0.5
    assert max(map(score, ("trash can in the kitchen", "kill the process", "idiot"))) < 0.2


def test_toxicity_machines_equal_the_rules():
    """Every clause of up to five classes against the rules, said plainly."""
    import itertools

    hits = (toxicity.INSULT, toxicity.THREAT)
    for n in range(6):
        for c in itertools.product(range(6), repeat=n):
            want = []
            for i, a in enumerate(c):
                if a not in hits:
                    want.append(0.0)
                    continue
                # a negation reaches the first hit behind it, over two other tokens at most
                back = next((j for j in range(i - 1, -1, -1) if c[j] == toxicity.NEG or c[j] in hits), None)
                w = 0.3 if back is not None and c[back] == toxicity.NEG and i - back <= 3 else 1.0
                w *= 0.6 if toxicity.REPORT in c[:i] else 1.0

                def aimed(rest):
                    left = 0
                    for x in rest:  # hits stand between without taking up room
                        left = 4 if x == toxicity.TARGET else left if x in hits else max(left - 1, 0)
                    return left > 0

                kind = toxicity.AIMED[a] if aimed(c[:i]) or aimed(c[:i:-1]) else a
                want.append(w * toxicity.WEIGHTS[kind])
            assert toxicity.clause_weights(list(c)) == pytest.approx(want), c


def test_toxicity_learns_from_labels(spark, empty):
    """Stems of invented words are found; odd labels do no harm; other rows, none or all with one label leave the seeds."""
    rng = __import__("random").Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    rows = [(i, " ".join([word() for _ in range(30)] + ([f"qux{word()}"] * 3 if i % 4 == 0 else []))) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)] + [(None, 1), (3, None), (999, 1), (0, 0)], "doc_id long, toxic int")
    lexicon = toxicity.fit_lexicon(docs, labels, train=F.col("doc_id") % 5 != 0)
    held = {r.doc_id: r.predicted for r in toxicity.score_toxicity(docs, lexicon).collect() if r.doc_id % 5 == 0}
    assert any("qux".startswith(s) or s.startswith("qux") for s in lexicon.stems) and held == {i: int(i % 4 == 0) for i in held}
    kept = {r.doc_id for r in toxicity.drop_toxic(docs, lexicon).collect()}
    assert kept == {i for i in range(200) if i % 4}
    for none in (labels.where("false"), labels.where("toxic = 0"), labels.where("doc_id is null")):
        assert toxicity.fit_lexicon(docs, none) == toxicity.Lexicon()
    assert toxicity.fit_lexicon(empty, labels) == toxicity.Lexicon() and toxicity.drop_toxic(empty, lexicon).count() == 0


def test_mixing(docs, labels, empty, odd):
    got = mixing.mix_to_targets(docs, mixing.language_quality(docs, labels))
    rows = got.collect()
    assert len(rows) == docs.count() and all(r.rate >= 0 and abs(sum(r.p) - 1) < 1e-6 for r in rows)
    table = got.select("n_tokens", "p")
    fit = mixing.fit_rates(table, ("a", "b", "c", "d")[: len(rows[0].p)])
    assert np.abs(fit.reached - fit.targets).max() <= 0.01 * fit.targets.sum()
    assert mixing.mix_to_targets(empty, mixing.language_quality(empty, labels)).count() == 0
    assert mixing.mix_to_targets(odd, mixing.language_quality(odd, labels)).count() == 5


def test_language_model_keeps_all_pairs(spark):
    """A pair seen once counts, and nothing that the model keeps has a largest size."""
    learned = [(i, f"p{i} q{i}") for i in range(400)]
    asked = [(1000, "p7 q7"), (1001, "p7 q8")]
    got = {r.doc_id: r.score for r in language_model.score(spark.createDataFrame(learned + asked, "doc_id long, text string"), F.col("doc_id") < 1000).collect()}
    assert got[1000] > got[1001] + 1
    assert not [x for x in vars(language_model) if x.startswith("MOST")]
