"""Stand-ins for models: answers made from digests of what they are asked, so that SQL can repeat them."""

from __future__ import annotations

import hashlib
import json

from matchloom.session import send_by_value

send_by_value(__name__)


def _hex(text: str) -> str:
    return hashlib.md5(text.encode()).hexdigest()


def digest_scorer():
    """Scores from 0 to 1 by (query, document); no answer for one pair in sixteen."""

    def score(query: str, document: str) -> float | None:
        answer = _hex(f"{query}|{document}")
        return None if answer[0] == "f" else int(answer[1:5], 16) / 65535

    return lambda queries, documents: [score(q, d) for q, d in zip(queries, documents)]


def digest_encoder():
    """Four numbers from 0 to 1 by text; no answer for one text in sixteen."""

    def vector(text: str) -> list[float] | None:
        answer = _hex(text)
        return None if answer[0] == "f" else [int(answer[i : i + 2], 16) / 255 for i in (1, 3, 5, 7)]

    return lambda texts: [vector(t) for t in texts]


def peer_follower():
    """Moves an expert half way to its peers' mean, by rules on the whole scores; fails for every 13th score."""

    def ask(row: dict) -> str:
        request = json.loads(row["request"])
        own = int(request["score"])
        if own % 13 == 0:
            raise RuntimeError("no answer")
        peers = sum(int(p["score"]) for p in request["peers"]) // len(request["peers"])
        stance = "maintain" if (own + 2 * peers) % 3 == 0 else "revise"
        return json.dumps({"stance": stance, "score": (own + peers) // 2, "reasoning": f"peers at {peers}"})

    return ask
