"""Splitting, packing, mixing and languages."""

import random

from pyspark.sql import functions as F

from weftline.llm import language as G
from weftline.llm import mix, pack, split, tokens

DOC = "doc_id long, text string, lang string, source string, label string, weight double, n_tokens string"
CHUNK = "id long, content string, start_line int, chunk_type string, pieces int, cut string"


def test_pieces_overlap_and_give_the_text_back(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice(["word ", "x", "\n", "\r\n", "\n\n", "é", "😀", "(", "  "]) for _ in range(n)) for n in (300, 1500, 4000)]
    rows = [(k, t, 10, "block", 1, "a") for k, t in enumerate(texts)] + [(50, "a" * 5000, None, None, None, None), (51, None, 1, None, None, None), (52, "", 1, None, None, None), (None, "b" * 3000, 1, None, None, None), (53, "x" * 1024, 1, None, None, None), (54, "x" * 1025, 1, None, None, None)]
    got = {}
    for r in split.split_oversized(spark.createDataFrame(rows, CHUNK)).orderBy("chunk_id", "piece_no").collect():
        got.setdefault(r.chunk_id, []).append(r)
    assert set(got) == {i for i, t, *_ in rows if i is not None and t and len(t) > 1024}
    for i, ps in got.items():
        text = next(r[1] for r in rows if r[0] == i)
        assert all(len(p.content) <= 1024 and p.content == text[p.start_char : p.end_char] for p in ps)
        assert all(b.start_char == a.end_char - 50 for a, b in zip(ps, ps[1:]))
        assert ps[0].content + "".join(p.content[50:] for p in ps[1:]) == text
        for p in ps:
            if p.start_line is not None:
                assert p.start_line == 10 + text[: p.start_char].count("\n") if i < 50 else True
    assert got[50][0].start_line is None and got[50][0].cut == "hard"


def test_cut_prefers_boundaries():
    text = ("alpha beta\n" * 120)[:1300]
    cuts = split.cut_points(text)
    assert cuts[0][2] == "line" and text[cuts[0][1] - 1] == "\n"
    assert split.cut_points("ab" * 2000)[0][2] == "hard"
    one_line = "word " * 400
    assert split.cut_points(one_line)[0][2] == "space"
    assert "\r\n" not in {("x" * 1023 + "\r\n" * 300)[c - 1 : c + 1] for _, c, _ in split.cut_points("x" * 1023 + "\r\n" * 300)}


def docs(spark, n=400):
    rng = random.Random(5)
    rows = [(k, " ".join(rng.choice(["index", "lock", "parser", "the", "of"]) for _ in range(rng.randint(1, 300))), "en", rng.choice(["A", " a", "b", "c", "d "]), "x", 0.5, "y") for k in range(n)]
    rows += [(n, "long " * 5000, "en", "a", None, None, None), (n + 1, "", None, "b", None, None, None), (n + 2, None, None, None, None, None, None), (None, "no id", None, "a", None, None, None), (0, rows[0][1], "en", "A", None, None, None)]
    return rows, spark.createDataFrame(rows, DOC)


def test_packing_holds_every_token_once(spark):
    rows, df = docs(spark)
    got = pack.pack_documents(df).collect()
    used = {}
    for r in got:
        used[r.container_id] = used.get(r.container_id, 0) + r.n_tokens
    assert max(used.values()) <= 2048
    want = {}
    for r in rows:
        if r[0] is not None:
            want[r[0]] = want.get(r[0], 0) + len(tokens.encode(r[1]))
    have = {}
    for r in got:
        have[r.doc_id] = have.get(r.doc_id, 0) + r.n_tokens
    assert have == want
    pieces = [r for r in got if r.doc_id == 400]
    assert len(pieces) > 1 and all(r.n_tokens == 2048 for r in pieces if r.piece_no < len(pieces) - 1)
    assert sum(used.values()) / (len(used) * 2048) > 0.9
    assert len({(r.container_id, r.place_in_container) for r in got}) == len(got)
    report = pack.fill_report(pack.pack_documents(df)).first()
    assert report.tokens == sum(want.values()) and report.fullest <= 2048
    assert pack.pack_documents(spark.createDataFrame([], DOC)).count() == 0


def test_hilbert_neighbours_are_one_step_apart():
    import numpy as np

    grid = np.array([[a, b] for a in range(8) for b in range(8)])
    order = np.argsort(tokens.hilbert(grid, bits=3))
    walk = grid[order]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()
    assert sorted(tokens.hilbert(grid, bits=3)) == list(range(64))


def test_mixture_reaches_its_shares(spark):
    rows, df = docs(spark)
    t = spark.createDataFrame([("a", 0.3, 1), ("B ", 0.4, 3), ("c", 0.2, 2), ("d", 0.1, 1), ("nowhere", 0.0, 1)], "source string, target_share double, max_repeats int")
    used, report = mix.mix_sources(df, t)
    rep = {r.source: r for r in report.collect()}
    for s in ("a", "b", "c", "d"):
        assert abs(rep[s].actual_share - rep[s].target_share) < 0.01
        assert rep[s].mixed_tokens <= rep[s].budget
    assert rep["nowhere"].mixed_tokens == 0
    limit = {"a": 1, "b": 3, "c": 2, "d": 1}
    twice = {0}
    for r in used.collect():
        assert r.times_used <= limit[r.source] * (2 if r.doc_id in twice else 1)
    small, rep2 = mix.mix_sources(df, t, total_tokens=5000)
    got = {r.source: r.mixed_tokens for r in rep2.collect()}
    assert sum(got.values()) <= 5000 and got["b"] > 1500
    none, rep3 = mix.mix_sources(spark.createDataFrame([], DOC), t)
    assert none.count() == 0 and rep3.count() == 5


def test_languages_on_held_out_sentences(spark):
    said = {
        "en": ["The parser reads every file before the index is built.", "We should talk about the lock in the next meeting."],
        "de": ["Der Parser liest jede Datei, bevor der Index gebaut wird.", "Wir sollten in der nächsten Sitzung über die Sperre reden."],
        "fr": ["L'analyseur lit chaque fichier avant que l'index soit construit.", "Nous devrions parler du verrou à la prochaine réunion."],
        "ru": ["Парсер читает каждый файл до построения индекса.", "Нам стоит обсудить блокировку на следующей встрече."],
    }
    rows = [(k * 10 + j, " ".join(v * (j + 1)), lab, "s", "x", 0.1, "y") for k, (lang, v) in enumerate(said.items()) for j, lab in enumerate([lang, lang.upper(), f" {lang}-{lang.upper()}"])]
    mixed = said["en"][0] + " " + said["en"][1] + "\n\n" + " ".join(said["de"])
    odd = [(100, mixed, "en", None, None, None, None), (101, " ".join(said["fr"]), "en", None, None, None, None), (102, " ".join(said["ru"]), None, None, None, None, None), (103, "", "en", None, None, None, None), (104, None, None, None, None, None, None), (105, "```\n" + " ".join(said["de"]) + "\n```", "en", None, None, None, None), (106, "ж" * 100_000, "ru", None, None, None, None), (None, "x", None, None, None, None, None), (101, " ".join(said["fr"]), "en", None, None, None, None)]
    out = G.label_documents(spark.createDataFrame(rows + odd, DOC))
    got = {r.doc_id: r for r in out.collect()}
    for i, *_ in rows:
        assert got[i].main_lang == list(said)[i // 10] and got[i].label == got[i].main_lang
    assert sorted(got[100].languages) == ["de", "en"] and got[101].main_lang == "fr" and got[102].main_lang == "ru"
    for i in (103, 104, 105, 106):
        assert got[i].languages == [] and (got[i].main_lang is None) == (i < 105) and (got[i].confidence is None) == (i < 105)
    assert got[105].main_lang == "de"
    assert None not in got
    seg = got[100].segments
    assert [s.lang for s in seg] == ["en", "de"] and mixed[seg[1].start : seg[1].end] == " ".join(said["de"])
    bad = {(r.doc_id, r.lang) for r in G.mislabelled(out).collect()}
    assert bad == {(100, "en"), (100, "de"), (101, "fr"), (102, "ru")}
    assert G.label_documents(spark.createDataFrame([], DOC)).count() == 0


def test_labels_in_usual_spellings(spark):
    names = ["EN", " en", "en-US", "eng", "English", "en_EN", "German", "deu", "ru-RU", "rus", "und", "xx", "unknown", "", None]
    df = spark.createDataFrame([(n,) for n in names], "lang string").select("lang", G.normal_label(F.col("lang")).alias("x"))
    assert [r.x for r in df.collect()] == ["en"] * 6 + ["de", "de", "ru", "ru"] + [None] * 5


def test_every_text_with_letters_has_a_language_and_its_confidence_means_something(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text", "lang")
    short = spark.createDataFrame([(-1, "we will talk about it later", None), (-2, "Das ist nur ein Satz.", None), (-3, "ok", None), (-4, "12 34 !", None), (-5, "la", "fr")], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in G.label_documents(docs.unionByName(short)).collect()}
    assert got[-1].main_lang == "en" and got[-2].main_lang == "de" and got[-1].languages == [] and got[-4].main_lang is None
    assert got[-3].main_lang and got[-3].confidence < 0.9 and got[-5].confidence < got[-1].confidence
    whole = [r for i, r in got.items() if i > 0 and r.languages and r.label]
    mixed = [r.confidence for r in whole if len(r.languages) > 1]
    assert all(c < 0.95 for c in mixed) and all(0 < r.confidence <= 1 for r in whole)
    letters = {r.doc_id for r in docs.where("text rlike '\\\\p{L}'").collect()}
    assert all(got[i].main_lang for i in letters)


def test_no_piece_is_nearly_empty_before_a_long_line():
    text = "short line\n" * 6 + " ".join(f"word{k}" for k in range(400)) + "\n" + "tail\n" * 300
    cuts = split.cut_points(text)
    assert all(b - a > 512 for a, b, _ in cuts[:-1]) and {how for *_, how in cuts} == {"space", "line", "end"}
    assert all(b - c == 50 for (_, b, _), (c, _, _) in zip(cuts, cuts[1:]))
    text = "intro words\n" * 6 + "x" * 3000
    assert [how for *_, how in split.cut_points(text)] == ["line", "hard", "hard", "hard", "end"]
