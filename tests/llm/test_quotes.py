"""Quotation linking on hand-made threads."""

from veridoc.llm import quotes as Q

MAILS = [
    (1, 1, "Shall we meet on Monday?\nI am free\nall day.", "a"),
    (2, 1, "Yes.\n\nOn Sunday X wrote:\n> Shall we meet on\n> MONDAY?  I am free\n>all day.\n", "a"),
    (3, 1, "> > Shall we meet on Monday?\n> > I am free all day.\n> Yes.\n\nGood, then.", "a"),
    (4, 1, ">> I am free\n\nOnly a part of it.\r\nTwo lines.", "a"),  # a line of 1, the passage between is missing
    (5, 1, "> Never written by anyone\nWhat?", "a"),
    (6, 1, None, "b"), (7, 1, "", "b"), (8, 1, ">\n> \n", "b"),
    (9, 1, "> Yes.\nFrom another folder.", "b"),
    (10, 1, "Yes.", "b"), (11, 1, "> yes.\nIn this folder.", "b"),
    (12, 1, "First part.\n> Good, then.\nSecond part.", "a"),
    (13, 1, "> Second part.\nA line of a run of its own.", "a"),
    (14, 1, "> own words\nown words", "a"),
    (15, 1, "x " * 100_000 + "\n" + "\n".join(f"> line {i}" for i in range(3000)), "a"),
    (16, 1, "Am Montag schrieb:\nno quote follows", "a"),
    (None, 1, "no number", "a"), (20, None, "> no number\nhere", "a"),
]
PARENTS = {2: 1, 3: 2, 4: 1, 9: 2, 11: 10, 12: 3, 13: 12, 20: None}


def frame(spark, rows):
    return spark.createDataFrame([(i, j, t, f, 1, 1) for i, j, t, f in rows], "n long, m long, text string, folder string, depth int, hash int")


def test_threads(spark):
    got = {r["n"]: r for r in Q.link_quotes(frame(spark, MAILS).repartition(3), ["n", "m"], scope="folder").collect()}
    assert len(got) == len(MAILS)
    for n, r in got.items():
        want = PARENTS.get(n)
        if n == 20:
            assert r["parent"]["n"] is None and r["parent"]["m"] == 1
        else:
            assert (r["parent"] and r["parent"]["n"]) == want, n
    assert [got[n]["depth"] for n in (1, 2, 3, 12, 13)] == [0, 1, 2, 3, 4] and all(got[n]["thread"]["n"] == 1 for n in (1, 2, 3, 4, 9, 12, 13))
    thread = sorted((r["place"], r["depth"], r["n"]) for r in got.values() if r["thread"]["n"] == 1)
    assert [p for p, _, _ in thread] == list(range(1, 8)) and thread == sorted(thread, key=lambda x: (x[1], x[2]))
    assert got[2]["own_text"] == "Yes." and got[3]["own_text"] == "Good, then." and got[12]["own_text"] == "First part.\nSecond part."
    assert got[4]["own_text"] == "Only a part of it.\nTwo lines." and got[6]["own_text"] == got[8]["own_text"] == ""
    assert (got[3]["n_quotes"], got[3]["n_linked"], got[5]["n_quotes"], got[5]["n_linked"], got[8]["n_quotes"]) == (2, 2, 1, 0, 0)
    assert got[14]["parent"] is None and got[16]["own_text"].startswith("Am Montag")


def test_long_chain_repeated_rows_and_nothing(spark):
    chain = [(i, 0, f"message {i}" + (f"\n> message {i - 1}" if i else ""), "a") for i in range(70)]
    chain += [(100 + i, 0, "same words", "b") for i in range(50)] + [(200, 0, "> same words\nreply", "c")] + [(5, 0, "message 5\n> message 4", "a")] * 3
    got = Q.link_quotes(frame(spark, chain), ["n", "m"]).collect()
    assert len(got) == len(chain)
    assert {(r["n"], r["depth"], r["place"]) for r in got if r["n"] < 70} == {(i, i, i + 1) for i in range(70)}
    assert next(r for r in got if r["n"] == 200)["parent"]["n"] == 100
    assert Q.link_quotes(frame(spark, chain).limit(0), ["n", "m"], scope="folder").count() == 0
