"""Operator 10: no result depends on how much of a conversation memory holds, nor on its number of turns."""

import hashlib

import pytest

from erlink.llm import chat
from tests.llm.test_other_operators import Early, LastForty


class Numbered(chat.MarkedTemplate):
    """Numbers its turns, a black box; never rewrites."""

    def __call__(self, turns):
        return super().__call__([(f"{i} {r}", t) for i, (r, t) in enumerate(turns)])


class NumberedStream(chat.MarkedTemplate):
    """The same as a stream, whose promise it breaks."""

    def pieces(self, turns):
        return super().pieces((f"{i} {r}", t) for i, (r, t) in enumerate(turns))


class Alternating(chat.MarkedTemplate):
    """Refuses conversations that do not begin with a user and then alternate."""

    def __call__(self, turns):
        if any(r != ("user", "assistant")[i % 2] for i, (r, _) in enumerate(turns)):
            raise TypeError
        return super().__call__(turns)


class Passing(chat.MarkedTemplate):
    """Changes its first turn only while there are 61 turns."""

    def __call__(self, turns):
        return super().__call__([("system", "61"), *turns[1:]] if len(turns) == 61 else turns)


class LastThree(chat.MarkedTemplate):
    """Drops all but the last three turns."""

    def __call__(self, turns):
        return super().__call__(turns[-3:])


TEMPLATES = [chat.MarkedTemplate, LastForty, Early, Numbered, NumberedStream, Alternating, Passing, LastThree]


def _want(conv, template, turns):
    """By definition: all prefixes and the whole rendering; loss texts are those that the whole rendering holds."""
    prefixes = [template(turns[:k]) if k else "" for k in range(len(turns) + 1)]
    rewrites = any(not b.startswith(a) for a, b in zip(prefixes, prefixes[1:]))
    read = template.parse(prefixes[-1])
    loss = "".join(t for r, t in read if r.split()[-1] == "assistant")
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return conv, len(read), digest("".join(f"{r}\n{t}\n" for r, t in read)), len(loss), digest(loss), len(prefixes[-1]), rewrites


@pytest.mark.parametrize("template", TEMPLATES)
@pytest.mark.parametrize("held", [100, 2000, 32_000_000])
def test_no_result_depends_on_what_memory_holds(template, held, monkeypatch):
    monkeypatch.setattr(chat, "HELD", held)
    monkeypatch.setattr(chat, "BLOCK", 150)
    cases = {n: [(("user", "assistant")[k % 2], f"turn {k}\\ </s> é\n" * (k % 4)) for k in range(n)] for n in (1, 5, 31, 34, 62, 100, 201)}
    rows = [(n, *turn) for n, turns in cases.items() for turn in turns]
    assert list(chat.read(rows, template())) == [_want(n, template(), turns) for n, turns in cases.items()]


def test_turns_on_disk_come_back_in_order(monkeypatch):
    monkeypatch.setattr(chat, "BLOCK", 10)
    past, turns = chat.Past(), [("r", "x" * (k % 7) + "\ud800é") for k in range(50)]
    assert not past and list(past) == []
    for k, turn in enumerate(turns):
        past.extend([turn])
        assert past and list(past) == turns[: k + 1]
    assert list(zip(past, past)) == list(zip(turns, turns))


def test_a_long_conversation_in_the_operator(spark):
    """More than ``HELD`` characters, with a template that rewrites."""
    turns = [("assistant", f"{k}" * 4_500_000) for k in range(8)]
    df = spark.range(8).selectExpr("1L AS conv_id", "id AS turn", "'assistant' AS role", "repeat(string(id), 4500000) AS text")
    assert sum(len(t) for _, t in turns) > chat.HELD
    assert [tuple(r) for r in chat.format_conversations(df, LastThree()).collect()] == [_want(1, LastThree(), turns)]
