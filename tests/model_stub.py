"""A pretend chat model for tests: rewrites the prompt's text and answers in one of several shapes."""

import json


def rule_model_factory():
    """A deterministic stand-in for a chat model, used by tests: it rewrites the prompt's text field and, keyed by the
    md5 of the prompt, answers in one of several shapes (clean, fenced,
    prose-wrapped, truncated, string list, alternate key, prediction only,
    unreadable), so every parsing path is exercised on real rows."""
    import hashlib

    def fn(stage: str, prompt: str) -> str:
        text = prompt.split("text=", 1)[1].split("\nplan=", 1)[0] if "text=" in prompt else prompt
        text = " ".join(text.split())
        h = int(hashlib.md5(prompt.encode("utf-8")).hexdigest()[:8], 16)
        kind = h % 8
        c1, c2 = text + " (one)", text + " (two)"
        objs = [{"candidate_id": "c1", "text": c1}, {"candidate_id": "c2", "text": c2}]
        if kind == 0:
            return json.dumps({"candidates": objs})
        if kind == 1:
            return "```json\n" + json.dumps({"candidates": objs}) + "\n```"
        if kind == 2:
            return "Here it is: " + json.dumps({"candidates": objs}) + " -- done."
        if kind == 3:
            full = json.dumps({"candidates": objs}, indent=1)
            return full[: max(1, len(full) - 7)]
        if kind == 4:
            return json.dumps({"candidates": [c1, "", c2]})
        if kind == 5:
            return json.dumps({"candidates": [{"output": c1}]})
        if kind == 6:
            return json.dumps({"prediction": c1})
        return "no json here: " + text

    return fn
