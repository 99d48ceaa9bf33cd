"""Answer texts. They format a few collected rows on the driver; the rows come from bounded queries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Row

from ..functions.text import query_words


def bar(score: float, width: int = 10) -> str:
    filled = int(score * width)
    return "█" * filled + "░" * (width - filled)


def persona_text(people: Sequence[Row], aspect: str = "full", topics: Sequence[Row] = ()) -> str:
    """What is known of each speaker, by aspect (habits, style, personality or full), and the topics that go with the question."""
    out = []
    for p in people:
        out.append(f"**{p['user_id']}** ({p['message_count']} messages)")
        if aspect in ("habits", "full"):
            for h in (p["habits"] or [])[:10]:
                out += [f"- {h['category'].replace('_', ' ').title()}: {h['detail']}", f"  from: {h['evidence'][:150]}"]
        if aspect in ("style", "full") and p["communication_style"]:
            s = p["communication_style"]
            out.append(f"- Writes {s['length_style']} messages, about {s['avg_words']} words; tone {s['formality']}, {s['enthusiasm']}; emoji use {s['emoji_level']}")
        if aspect in ("personality", "full"):
            for t in (p["personality_traits"] or [])[:8]:
                out.append(f"- {t['trait'].replace('_', ' ').title()}: {bar(t['score'])} {t['score']:.0%}")
                out += [f"  as in: {x[:120]}" for x in (t["evidence_samples"] or [])[:1]]
        if aspect == "full":
            by: dict[str, list[str]] = {}
            for f in p["personal_facts"] or []:
                by.setdefault(f["category"], []).append(f["detail"])
            out += [f"- {k.replace('_', ' ').title()}: {'; '.join(v[:3])}" for k, v in by.items()]
    if out and topics:
        out += ["Talked about in:"] + [f"- {t['topic_label']} (messages {t['start_msg_index']}-{t['end_msg_index']})" for t in topics[:3]]
    return "\n".join(out) or "No persona is stored."


def contextual_text(question: str, found: Mapping[str, DataFrame]) -> str:
    """The retrieved topics, message chunks and checkpoints."""
    topics, chunks, checkpoints = (found[k].collect() for k in ("topics", "messages", "checkpoints"))
    if not (topics or chunks or checkpoints):
        return f"Nothing was found about: {question}"
    out = [f"Found for: {', '.join(query_words(question)) or question}"]
    out += [f"- Topic {t['topic_label']} (messages {t['start_msg_index']}-{t['end_msg_index']})" for t in topics[:5]]
    for c in chunks[:5]:
        out += [f"  > {m['full_text']}" for m in c["messages"][:5]]
    out += [f"- {c['summary'][:300]}" for c in checkpoints[:2]]
    return "\n".join(out)


def colour(score: float) -> str:
    return "green" if score > 0.3 else "red" if score < -0.3 else "yellow"


def merged_text(entity: str | None, mentions: Sequence[Row], pairs: Sequence[Row]) -> str:
    """Mentions of an entity day by day, and where they contradict each other."""
    if not entity:
        return "The question names nothing to look for."
    if not mentions:
        return f"Nothing was said about {entity}."
    days: dict[str, list[Row]] = {}
    for m in mentions:
        days.setdefault(m["day_label"], []).append(m)
    out = [f"{len(mentions)} mentions of **{entity}**:"]
    for day, rows in list(days.items())[:5]:
        out += [f"- {day}: {r['text'][:200]} ({colour(r['compound'])})" for r in rows[:2]]
    out += [f"! {p['contradiction_type']} ({p['confidence']:.2f}) {p['detail']}".rstrip() for p in pairs[:3]]
    return "\n".join(out)
