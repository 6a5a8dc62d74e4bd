from patchlight.llm.line_rules import clean_lines


def rows_of(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["doc_id"]: r for r in clean_lines(docs).collect()}


def brute_repeated(text):
    w = text.encode().split()
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    return len({i + d for i, x in enumerate(windows) if windows.count(x) > 1 for d in range(3)})


def test_repeated_windows_match_brute_force(spark):
    texts = ["a b c a b c", "a a a a", "a b", "", "a b c d", "x y z q x y z q x", "A b c a b c"]
    got = rows_of(spark, texts)
    for k, t in enumerate(texts):
        assert got[k]["n_repeat_words"] == brute_repeated(t), t


def test_rules_remove_lines_and_reject(spark):
    good = " ".join(f"word{k}" for k in range(60)) + "."
    menu = "Home | News | About | Contact | Help"
    got = rows_of(spark, [good, good + "\n" + menu + "\nAll rights reserved by us.", "\n".join([good] + [menu] * 10), "\n".join(f"Buy{k}!! Now{k}!!" for k in range(40))])
    assert got[0]["kept"] and got[0]["n_failed_lines"] == 0
    assert got[1]["kept"] and got[1]["clean_text"] == good and got[1]["n_failed_lines"] == 2
    assert not got[2]["kept"] and got[2]["n_dup_lines"] == 9
    assert not got[3]["base_failed"] and not got[3]["kept"]


def test_odd_rows(odd_docs, no_docs):
    rows = clean_lines(odd_docs.withColumnRenamed("key", "kept")).collect()
    assert len(rows) == odd_docs.count() and clean_lines(no_docs).count() == 0
    by = {r["doc_id"]: r for r in rows}
    assert by[3]["n_words"] == by[4]["n_words"] == by[5]["n_words"] == 0 and not by[3]["kept"]
    assert by[8]["n_words"] == 1 and by[11]["word_chars"] == 6 and by[6]["n_words"] == 30_000
