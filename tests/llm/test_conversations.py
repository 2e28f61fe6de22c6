"""Conversation repair against an exhaustive search, in pieces and whole, and on odd rows."""

import itertools
import random
import re

import pytest

from chromagrid.llm import conversations, registry

RIGHT = re.compile("(s?(ua)+)?")


def searched(rows):
    """(cost, audit, roles) of the best among all edits with up to two rows inserted at each place."""
    best = None
    gaps = [("", *"ua", "uu", "ua", "au", "aa")] * (len(rows) + 1)
    for kinds in itertools.product("KuaD", repeat=len(rows)):
        if any(go and k != "D" for (_, go, _), k in zip(rows, kinds, strict=True)):
            continue
        for news in itertools.product(*gaps):
            roles, audit, cost = news[0], "I" * len(news[0]), 2 * len(news[0])
            for (initial, _, cut), k, new in zip(rows, kinds, news[1:], strict=True):
                roles += {"K": initial, "D": ""}.get(k, k) + new
                audit += ("R" if k in "ua" else k) + "I" * len(new)
                cost += {"K": 0, "D": 3}.get(k, 2) + (cut and k != "D") + 2 * len(new)
            if RIGHT.fullmatch(roles) and (best is None or (cost, audit) < best[:2]):
                best = cost, audit, roles
    return best


def test_search_equals_all_edits():
    rng = random.Random(4)
    for _ in range(60):
        rows = [(rng.choice("suaux "), rng.random() < 0.2, rng.random() < 0.3) for _ in range(rng.randrange(4))]
        assert conversations.cheapest(rows) == searched(rows)[:2]


def test_chained_pieces_equal_the_whole():
    rng = random.Random(5)
    for _ in range(200):
        rows = [(rng.choice("suauat"), rng.random() < 0.2, rng.random() < 0.3) for _ in range(rng.randrange(1, 30))]
        cuts = sorted(rng.sample(range(len(rows) + 1), min(3, len(rows))))
        pieces = []
        for part in (rows[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)], strict=True)):
            costs, audits = [-1] * 16, [""] * 16
            for start in conversations.STATES:
                for cost, audit, state in conversations.paths(part, start):
                    costs[4 * start + state], audits[4 * start + state] = cost, audit
            pieces.append((costs, audits))
        cost, chosen = conversations.chained(pieces)
        assert (cost, "".join(a for _, a in chosen)) == conversations.cheapest(rows)


def odd_rows():
    long = "word. " * 60_000
    rows = [(None, None, None, None), (None, 1, "user", "Hi."), (None, 2, "assistant", "Yes."), (1, 0, "user", long), (1, 0, "user", long), (1, 0, "assistant", "Same turn."), (1, None, "system", "First."), (2, 5, "", ""), (2, 7, "tool", "What?"), (2, 9, "users", "ok")]
    return rows + [(3, t, "ua"[t % 2] + "x", f"Text {t}.") for t in range(40)] + [(4, 1, "user", "Again.")] * 30 + [(5, t, "user", " \t") for t in range(9)]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "i", 0) for r in rows], "conv_id bigint, turn bigint, role string, text string, id string, piece int")


@pytest.mark.parametrize(("piece_rows", "damage"), [(512, True), (3, True), (512, False), (2, False)])
def test_odd_rows_in_pieces_and_whole(spark, duck, piece_rows, damage, monkeypatch):
    monkeypatch.setattr(conversations, "PIECE_ROWS", piece_rows)
    rows = odd_rows()
    got = sorted((tuple(r) for r in conversations.repairs(frame(spark, rows), damage=damage).collect()), key=str)
    assert len({r[0] for r in got}) == len(got) == 6
    held = frame(spark, rows).toPandas()  # noqa: F841
    sql = registry.SQL["op11_conversation_repair"].replace("FROM conversations", "FROM (SELECT conv_id::BIGINT AS conv_id, turn::BIGINT AS turn, role, text FROM held)")
    if not damage:
        sql = sql.replace("4294967295) % 20 AS kind", "4294967295) * 0 + 9 AS kind")
    assert got == sorted(duck.execute(sql).fetchall(), key=str)


def test_no_rows(spark):
    assert conversations.repairs(frame(spark, [])).count() == 0


def test_the_whole_table_in_small_pieces(spark, sf_dir, compare, monkeypatch):
    monkeypatch.setattr(conversations, "PIECE_ROWS", 2)
    compare(registry.QUERIES["op11_conversation_repair"](spark, sf_dir), registry.SQL["op11_conversation_repair"])
