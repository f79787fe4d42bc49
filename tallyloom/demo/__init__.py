"""The bundled demo: invented tickets, questions about them, and what a person would answer."""

from __future__ import annotations

import os

HERE = os.path.dirname(os.path.abspath(__file__))
QUESTIONS = f"{HERE}/questions.yaml"

OPENINGS = ("Hello,", "Hi team,", "To whom it may concern,", "Good morning,", "Once more:")
TROUBLES = {
    "billing": ("the invoice of this month lists a seat twice", "my card was charged two times", "the refund has not arrived", "the receipt shows a wrong address"),
    "technical": ("the export stops with an error", "nobody can log in since the update", "the page stays blank on my phone", "the import loses every second row"),
    "other": ("where do I find the handbook", "please change the name on our account", "is there a discount for schools", "thank you for the quick help"),
}
ENDINGS = (("No hurry.", False), ("Please have a look some time.", False), ("We are blocked and need this today, it is urgent!", True), ("Regards", False), ("This is urgent, our customers are waiting.", True))


def tickets(n: int = 60) -> list[tuple[str, str, str, str, str]]:
    """(ticket_id, subject, body, topic, urgent) of ``n`` tickets; the last two are the gold answers."""
    topics, out = list(TROUBLES), []
    for k in range(n):
        topic = topics[k % len(topics)]
        trouble = TROUBLES[topic][(k // 3) % 4]
        end, urgent = ENDINGS[(k * 7) % len(ENDINGS)]
        out.append((f"T-{k:04d}", trouble[:24], f"{OPENINGS[k % 5]} {trouble}. Our reference is {1000 + 37 * k}. {end}", topic, "true" if urgent else "false"))
    return out


#: Words that speak for an answer, for the lexical answerer.
WORDS = {
    "is_urgent": {"true": ("urgent!", "urgent,", "blocked", "today,", "waiting."), "false": ("no", "hurry.", "some", "time.", "regards")},
    "topic": {"billing": ("invoice", "card", "refund", "receipt", "charged", "seat"), "technical": ("export", "error.", "log", "update.", "page", "blank", "import", "row."), "other": ("handbook.", "name", "discount", "thank", "account.", "schools.")},
}
