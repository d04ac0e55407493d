"""Prompts for the analyser, and its answers read with any type in any place."""

from __future__ import annotations

import json
import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as X

MAX_CONTENT = 3000
MAX_PUSHES = 500

# Options in the order in which they are looked for, and the fallback.
ARTICLE_TYPES = (("新聞", "問卦", "心得", "爆掛", "閒聊"), "其他")
AD_LIKELIHOOD = (("高度", "疑似"), "無")
FACTUALITY = (("事實", "觀點", "未證實"), "觀點")
SENTIMENT = ((("正", "正面"), ("負", "負面")), "中立")
CONTROVERSY = ((("高", "高"), ("中", "中")), "低")
AI_GENERATED = ((("疑似", "疑似AI"), ("人寫", "人寫")), "不確定")


def prompt(title: Column, author: Column, content: Column, pushes: Column, total: Column | None = None) -> Column:
    """The analyser's prompt; pushes are an ordered array of (seq, tag, user_id, content), ``total`` of them in all."""
    body = F.coalesce(content, F.lit(""))
    body = F.when(F.length(body) > MAX_CONTENT, F.concat(F.left(body, F.lit(MAX_CONTENT)), F.lit("\n...(內容過長已截斷)"))).otherwise(body)
    n = F.coalesce(F.size(pushes) if total is None else total, F.lit(0))
    note = F.when(n > MAX_PUSHES, f"，僅顯示前 {MAX_PUSHES} 則").otherwise("")
    lines = F.transform(
        F.slice(pushes, 1, MAX_PUSHES), lambda p: F.concat(F.coalesce(p["tag"], F.lit("")), F.lit(" "), F.coalesce(p["user_id"], F.lit("")), F.lit(": "), F.coalesce(p["content"], F.lit("")))
    )
    said = F.concat(F.lit("\n--- 推文（共 "), n.cast("string"), F.lit(" 則"), note, F.lit("）---\n"), F.array_join(lines, "\n"))
    return F.concat_ws(
        "\n",
        F.concat(F.lit("標題："), X.title_or_default(F.nullif(title, F.lit("")))),
        F.when(F.length(author) > 0, F.concat(F.lit("作者："), author)),
        F.lit("\n--- 文章內容 ---"),
        body,
        F.when(n > 0, said).otherwise("\n--- 推文：（無）---"),
    )


def _contained(value, options, fallback: str) -> str:
    text = value if isinstance(value, str) else ""
    for o in options:
        sign, label = o if isinstance(o, tuple) else (o, o)
        if sign in text:
            return label
    return fallback


def extract_json(raw: str) -> str:
    """What stands between the first { and the last } of an answer, fenced or not."""
    m = re.search(r"\{.*\}", raw, re.DOTALL)
    return m[0] if m else re.sub(r"^```(?:json)?|```$", "", raw.strip()).strip()


def _share(value) -> int:
    number = isinstance(value, (int, float)) and not isinstance(value, bool) and math.isfinite(value)
    return min(100, max(0, math.floor(value + 0.5))) if number else 0


def _text(value) -> str:
    return value.strip() if isinstance(value, str) else ""


def entities(value) -> list[dict]:
    """Named objects, eight at most: names cut to 40 characters, types to 10."""
    named = [e for e in value if isinstance(e, dict) and _text(e.get("name"))] if isinstance(value, list) else []
    kinds = ["其他" if e.get("type") is None else str(e["type"]) for e in named[:8]]
    return [{"name": _text(e["name"])[:40], "type": k[:10]} for e, k in zip(named, kinds)]


def parse_analysis(raw: str) -> dict:
    """The fields of an answer; raises ValueError for bad JSON or an empty summary."""
    found = json.loads(extract_json(raw))
    if not isinstance(found, dict) or not _text(found.get("tldr")):
        raise ValueError("empty tldr")
    strings = lambda v: [x for x in v if isinstance(x, str)] if isinstance(v, list) else []
    stance = found.get("push_stance") if isinstance(found.get("push_stance"), dict) else {}
    return {
        "tldr": _text(found["tldr"]),
        "community_take": found["community_take"] if isinstance(found.get("community_take"), str) else "",
        "top_comments": "\n".join(strings(found.get("top_comments"))),
        "sentiment": _contained(found.get("sentiment"), *SENTIMENT),
        "controversy": _contained(found.get("controversy"), *CONTROVERSY),
        "tags": json.dumps(strings(found.get("tags")), ensure_ascii=False),
        "article_type": _contained(found.get("article_type"), *ARTICLE_TYPES),
        "entities": json.dumps(entities(found.get("entities")), ensure_ascii=False),
        "ad_likelihood": _contained(found.get("ad_likelihood"), *AD_LIKELIHOOD),
        "factuality": _contained(found.get("factuality"), *FACTUALITY),
        "ai_generated": _contained(found.get("ai_generated"), *AI_GENERATED),
        "push_stance": json.dumps({k: _share(stance.get(k)) for k in ("pro", "con", "neutral")}),
        "push_facts": _text(found.get("push_facts")),
        "qa_summary": _text(found.get("qa_summary")),
    }
