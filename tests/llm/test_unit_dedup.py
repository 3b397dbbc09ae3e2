"""Line dedup against a plain version."""

import random

from papergraph.llm.unit_dedup import remove_units, repeated_units


def test_lines_stay_where_they_rank_first(spark):
    line = "one two three four five six seven eight nine ten"
    texts = {4: f"é intro\n{line.upper()}\nother", 2: f"{line}\nshort\n  {line}", 7: None, 9: "", 5: f"{line} eleven\n{line} eleven"}
    df = spark.createDataFrame([*texts.items(), (4, texts[4])], "doc_id long, text string")
    got = repeated_units(df).collect()
    seen, want = set(), {}
    for i in sorted(texts):
        at, gone, n = 0, [], 0
        for x in (texts[i] or "").split("\n"):
            key = tuple(x.lower().split())
            if len(key) >= 10:
                n += 1
                if key in seen:
                    gone.append(f"{at}:{at + len(x)}")
                seen.add(key)
            at += len(x) + 1
        want[i] = (n, len(gone), ",".join(gone))
    assert sorted((r["doc_id"], r["n_units"], r["n_removed"], r["removed"]) for r in got) == sorted((i, *want[i]) for i in [*texts, 4])
    assert repeated_units(df.limit(0)).count() == 0


def removed_texts(spark, texts):
    got = repeated_units(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")).collect()
    spans = {r["doc_id"]: [tuple(map(int, x.split(":"))) for x in filter(None, r["removed"].split(","))] for r in got}
    assert all(r["n_removed"] == len(spans[r["doc_id"]]) and r["removed_chars"] == sum(b - a for a, b in spans[r["doc_id"]]) for r in got)
    return [[texts[i][a:b] for a, b in spans[i]] for i in range(len(texts))]


def test_passages_of_short_lines_are_removed_whole(spark):
    verse = "\n".join(f"é verse {k} of\n\nthe song" if k % 3 else f"v{k}" for k in range(20))
    long = [" ".join(f"{c}{k}" for k in range(12)) for c in "ab"]
    mixed = f"{long[0]}\nshort one\n{long[1]}"
    got = removed_texts(spark, [f"an intro\n{verse}\nan end", f"{long[0]}\n{verse}\nother end", mixed, f"start\n{mixed}\nend", "few\nwords", "few\nwords"])
    assert got == [[], [verse], [long[0]], [mixed], [], ["few\nwords"]]


def test_short_runs_against_a_plain_version(spark):
    import random

    rng = random.Random(4)
    texts = ["\n".join(rng.choice(["", "a", "b c", "d e f g", "h i j k l m n", "o p q r s t u v w x"]) for _ in range(rng.randrange(1, 40))) for _ in range(30)]
    first, units = {}, []
    for i, t in enumerate(texts):
        lines, at, mine = t.split("\n"), 0, set()
        place = [(at := at + len(x) + 1) - len(x) - 1 for x in lines]
        w = [x.split() for x in lines]
        for a in range(len(lines)):
            for b in range(a, len(lines)):
                n, part = sum(map(len, w[a : b + 1])), range(a, b + 1)
                all_short = all(len(w[k]) < 10 for k in part) and w[a] and w[b] and n >= 10
                ends = [k for k in (a, b) if len(w[k]) >= 10]
                edge = lambda ks: next((len(w[k]) >= 10 for k in ks if w[k]), True)  # noqa: E731  the next piece is long, or there is none
                whole_run = b > a and len(ends) == 1 and (edge(range(b + 1, len(w))) if ends == [a] else edge(range(a - 1, -1, -1)))  # noqa: B023
                link = whole_run and w[a] and w[b] and n - len(w[ends[0]]) < 10 and all(len(w[k]) < 10 for k in part[1:-1])
                tiny = n == sum(map(len, w)) < 10 and w[a] and w[b]
                # the fewest lines from a on, or the fewest up to b
                fewest = n - len(w[b]) < 10 or n - len(w[a]) < 10
                if (all_short and fewest) or (a == b and n >= 10) or link or tiny:
                    mine.add((place[a], place[b] + len(lines[b]), tuple(x for k in part for x in w[k])))
        units.append(mine)
        for s, _, key in sorted(mine):
            first.setdefault(key, (i, s))
    want = []
    for i, t in enumerate(texts):
        gone = []
        for s, e, key in sorted(units[i]):
            if first[key] != (i, s):
                if gone and s < gone[-1][1]:
                    gone[-1][1] = max(e, gone[-1][1])
                else:
                    gone.append([s, e])
        want.append([t[a:b] for a, b in gone])
    assert removed_texts(spark, texts) == want and sum(map(len, want)) > 20


def prose(rng, n):
    words = [f"w{rng.randrange(10**6)}" for _ in range(n)]
    return " ".join(w.capitalize() + "" if k % 12 == 0 else w + "." * (k % 12 == 11) for k, w in enumerate(words))


def test_passages_inside_lines_are_found_and_clean_texts_are_not(spark):
    rng = random.Random(7)
    passage, stock = prose(rng, 72), "All rights of this text are with the ones who wrote it."
    texts = [prose(rng, 200) for _ in range(8)]
    texts[2] = f"{texts[2][:401]} cut here {passage} and on it goes {texts[2][401:]}"
    texts[5] = f"{texts[5]}\n{passage.upper()} {prose(rng, 30)}"
    texts[6] = f"{texts[6]}\n{stock}"
    texts[7] = f"{stock}\n{texts[7]}"
    df = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in repeated_units(df).collect()}
    assert sorted(i for i in got if got[i]["repeats"]) == [2, 5]
    assert got[2]["repeat_words"] >= 60 and got[2]["n_removed"] == 0
    # the passage's first sentence is cut in the one text by the words before it
    a, b = map(int, got[5]["removed"].split(":"))
    assert texts[5][a:b] in passage.upper() and b - a > 0.75 * len(passage)
    assert got[7]["n_removed"] == 1 and not got[7]["repeats"] and got[6]["n_removed"] == 0


def test_passages_that_start_and_end_amid_sentences_repeat(spark):
    rng = random.Random(8)
    words = [f"w{rng.randrange(10**6)}" for _ in range(300)]
    clauses = lambda ws: " ".join(w + (",;:."[k // 6 % 4] if k % 6 == 5 else "") for k, w in enumerate(ws))
    texts = [clauses(words[:100]).split(), clauses(words[100:200]).split()]
    passage = texts[0][20:72]
    texts = [" ".join(texts[0]), " ".join([*texts[1][:27], *passage, *texts[1][27:]]), " ".join([*clauses(words[200:]).split()[:50], *passage[:20]])]
    got = {r["doc_id"]: r for r in repeated_units(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")).collect()}
    assert sorted(i for i in got if got[i]["repeats"]) == [0, 1] and got[2]["repeat_words"] < 20
    a, b = map(int, got[1]["removed"].split(":"))
    assert texts[1][a:b] in " ".join(passage) and len(texts[1][a:b].split()) >= 40


def test_removal_keeps_rows_columns_and_first_occurrences(spark):
    line = "one two three four five six seven eight nine ten"
    rows = [(1, f"{line}\nend", "a"), (2, f"{line}. Then more\n{line}", "b"), (2, None, "c"), (None, f"x\n{line}", "d"), (4, "", "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = remove_units(df)
    assert got.columns == df.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, "\nend", "a"), (2, f"{line}. Then more\n", "b"), (2, None, "c"), (None, f"x\n{line}", "d"), (4, "", "e")], key=str)
    assert remove_units(df.limit(0)).count() == 0


def test_ends_of_a_passage_and_short_copies_go_too(spark):
    long = [" ".join(f"{c}{k}" for k in range(16)) for c in "ab"]
    passage = f"Short heading here\n{long[0]}\nmiddle part\n{long[1]}\nclosing words"
    got = removed_texts(spark, [passage, f"{passage}", "tiny exact copy", "Tiny  exact\tCOPY", "tiny exact", ""])
    assert got == [[], [passage], [], ["Tiny  exact\tCOPY"], [], []]


def test_texts_that_fool_a_polynomial_have_digests_of_their_own(spark):
    bits = [bin(k).count("1") % 2 for k in range(4096)]
    texts = [" ".join("ab"[x] for x in bits), " ".join("ba"[x] for x in bits), "".join("ab"[x] for x in bits) + " x" * 12, "".join("ba"[x] for x in bits) + " x" * 12]
    assert removed_texts(spark, texts) == [[], [], [], []]
    assert removed_texts(spark, texts[:1] * 2) == [[], [texts[0]]]


def test_removal_keeps_columns_of_its_own_names(spark):
    df = spark.createDataFrame([(1, "few words", "a", "b"), (2, "few words", "c", "d")], "doc_id long, text string, _cut_id string, _cut_same string")
    assert sorted(map(tuple, remove_units(df).collect())) == [(1, "few words", "a", "b"), (2, "", "c", "d")]


def test_a_very_long_run_of_short_pieces(spark):
    song = "\n".join(f"v{k} la" for k in range(100_000))
    got = {r["doc_id"]: r for r in repeated_units(spark.createDataFrame([(1, song), (2, f"own start\n{song}")], "doc_id long, text string")).collect()}
    assert got[1]["n_removed"] == 0 and got[2]["removed"] == f"10:{10 + len(song)}" and got[1]["repeats"] and got[2]["repeats"]


def test_a_very_long_text_and_a_very_common_line(spark):
    line = "a line of twelve words that very many of the texts here hold"
    long = "\n".join(f"{k} words of a line that no other text has in it at all" for k in range(40_000))
    df = spark.createDataFrame([(0, f"{line}\n{long}"), *((i, f"{line}\nown {i}") for i in range(1, 400))], "doc_id long, text string")
    got = {r["doc_id"]: r for r in repeated_units(df).collect()}
    assert got[0]["n_removed"] == 0 and got[0]["n_units"] == 40_001
    assert all(r["removed"] == f"0:{len(line)}" for i, r in got.items() if i)
