"""Deterministic stand-ins for a user's embedding model and reply generator."""

from __future__ import annotations

from corpusloom.options import AgentOptions

LETTERS = "aent"


def make_embed():
    """Vectors of letter counts."""
    import numpy as np

    def embed(texts):
        return np.array([[float(t.count(c)) for c in LETTERS] for t in texts])

    return embed


def make_generate():
    """Searches for the first word it is given, then answers from the report."""

    def generate(messages):
        last = messages[-1]["content"]
        if last.startswith("Observation:"):
            asked = next(line for line in last.split("\n") if line.startswith("Query: "))
            return f"Thought: enough\nFinal Answer: about {asked[7:]}", 1, 2
        return f'Thought: look\nAction: agent_search("{last.split()[0]}")', 1, 0

    return generate


def make_counter_reply():
    """Replies with the number of messages and the last role."""

    def generate(messages):
        return f"{len(messages)} {messages[-1]['role']}", len(messages), 0

    return generate


AGENT = AgentOptions(search_first="search", fix_format="format", answer_now="answer", keep_going="next")
