import pytest

from patchlight.llm.chat_pairs import conversations, format_pairs, preference_pairs

TURNS = "conv_id long, turn long, role string, text string, other string"


def made(spark, rows):
    turns = spark.createDataFrame([(*r, "x") for r in rows], TURNS)
    return {r["chosen_id"]: r for r in format_pairs(preference_pairs(turns)).collect()}


def rendered(role, text):
    return f"<|im_start|>{role}\n{text}<|im_end|>\n"


def test_prompt_is_rendered_once_and_masks_cover_the_assistant(spark):
    got = made(spark, [(1, 0, "user", "hi"), (1, 1, "assistant", "good"), (1, 2, "user", "more"), (1, 3, "assistant", "yes"), (2, 0, "user", "hi"), (2, 1, "assistant", "bad")])
    r = got[1]
    assert r["rejected_id"] == 2 and r["answer_id"] is None and r["n_common"] == 1
    assert r["prompt"] == rendered("user", "hi")
    assert [r["chosen"][a:b] for a, b in r["chosen_mask"]] == ["good<|im_end|>", "yes<|im_end|>"]
    assert [r["rejected"][a:b] for a, b in r["rejected_mask"]] == ["bad<|im_end|>"]


def test_one_without_a_partner_is_rejected_with_anothers_answer(spark):
    a = [("user", "a1"), ("assistant", "a2"), ("user", "a3"), ("assistant", "a4"), ("user", "a5")]
    b = [("system", "b0"), ("assistant", "b1"), ("assistant", "b2")]
    rows = [(3, k, *t) for k, t in enumerate(a)] + [(9, k, *t) for k, t in enumerate(b)] + [(70, 0, "user", "far"), (70, 1, "assistant", "off"), (11, 0, "user", "no answer")]
    got = made(spark, rows)
    assert (got[3]["answer_id"], got[3]["n_common"], got[9]["answer_id"], got[9]["n_common"]) == (9, 3, 70, 2)
    assert got[3]["prompt"] == "".join(rendered(*t) for t in a[:3]) and got[3]["chosen"] == rendered(*a[3]) + rendered(*a[4])
    assert got[3]["rejected"] == rendered(*b[2]) and got[9]["rejected"] == rendered("assistant", "off")
    assert [got[9]["rejected"][x:y] for x, y in got[9]["rejected_mask"]] == ["off<|im_end|>"]
    # The last one is lent the first one's answer, however far apart their ids are; 11 has no answer.
    assert got[70]["answer_id"] == 3 and got[70]["n_common"] == 1 and got[70]["rejected"] == rendered(*a[3])
    assert got[11]["n_common"] == 0 and got[11]["answer_id"] is None and got[11]["rejected"] == ""


@pytest.mark.parametrize("shared", [0, 1, 7, 300])
def test_long_shared_prefixes(spark, shared):
    base = [("user" if k % 2 == 0 else "assistant", f"t{k} " * 50) for k in range(shared)]
    rows = [("c", k, *t, "x") for k, t in enumerate([*base, ("assistant", "one"), ("user", "same")])] + [("r", k, *t, "x") for k, t in enumerate([*base, ("assistant", "two"), ("user", "same"), ("assistant", "three")])]
    whole = conversations(spark.createDataFrame(rows, TURNS.replace("conv_id long", "conv_id string")))
    pairs = whole.filter("conv_id = 'c'").selectExpr("turns AS chosen_turns").crossJoin(whole.filter("conv_id = 'r'").selectExpr("turns AS rejected_turns"))
    r = format_pairs(pairs).first()
    assert r["n_common"] == shared and r["prompt"] == "".join(rendered(*t) for t in base)
    assert [r["rejected"][a:b] for a, b in r["rejected_mask"]] == ["two<|im_end|>", "three<|im_end|>"]


def test_a_prefix_and_odd_turns(spark):
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "a"), (2, 0, "user", "q"), (3, 0, None, None), (3, None, "user", None), (4, 0, "user", "z"), (None, 0, "user", "q"), (5, 1, "assistant", "b"), (5, 1, "assistant", "b"), (6, 0, "user", "x" * 300_000), (6, 1, "assistant", "")]
    got = made(spark, rows)
    assert got[1]["rejected_id"] == 2 and got[1]["rejected"] == "" and got[1]["n_common"] == 1 and got[1]["rejected_mask"] == []
    assert got[4]["n_common"] == 0 and got[4]["prompt"] == ""
    assert got[3]["chosen"] == rendered("user", "") + rendered("", "")
    assert got[5]["n_common"] == 1 and got[5]["answer_id"] == 6 and got[5]["rejected"] == rendered("assistant", "")
    assert len(got[6]["prompt"]) > 300_000 and set(got) == {1, 3, 4, 5, 6}


def test_fields_are_not_run_together(spark):
    got = made(spark, [(1, 0, "user\x1fa", "b"), (1, 1, "assistant", "y"), (2, 0, "user", "a\x1fb"), (2, 1, "assistant", "z")])
    assert all(r["rejected_id"] is None for r in got.values()) and got[1]["prompt"] == rendered("user\x1fa", "b")


def test_one_opening_shared_by_many_makes_a_linear_number_of_pairs(spark):
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", "same" if t == 0 else f"{c} {t}") for c in range(301) for t in range(2)]
    got = made(spark, rows)
    ids = [i for r in got.values() for i in (r["chosen_id"], r["rejected_id"]) if i is not None]
    assert sorted(ids) == list(range(301)) and sum(r["rejected_id"] is None for r in got.values()) == 1


def test_empty(spark):
    assert format_pairs(preference_pairs(spark.createDataFrame([], TURNS))).count() == 0


@pytest.mark.parametrize("kind", ["sparse", "text"])
def test_sparse_and_text_ids_find_partners(spark, kind):
    name = (lambda c: c * 10**15 + 7) if kind == "sparse" else (lambda c: f"talk-{c}")
    rows = [(name(c), t, "user" if t % 2 == 0 else "assistant", f"{c} {t}", "x") for c in range(150) for t in range(2)]
    turns = spark.createDataFrame(rows, TURNS if kind == "sparse" else TURNS.replace("conv_id long", "conv_id string"))
    got = preference_pairs(turns).collect()
    assert len(got) == 150 and all(r["answer_id"] not in (None, r["chosen_id"]) for r in got)
    lent = sorted(r["answer_id"] for r in got)
    assert lent == sorted(name(c) for c in range(150))
