"""Builds transcript lines for tests."""

import json


class Log:
    """Builds transcript lines with a clock."""

    def __init__(self, sid="s1", path="/logs/p/s1.jsonl"):
        self.sid, self.path, self.rows, self.t = sid, path, [], 0

    def at(self, minutes):
        self.t = minutes * 60
        return self

    def add(self, **rec):
        hours, rest = divmod(int(self.t), 3600)
        stamp = f"2026-01-01T{hours:02d}:{rest // 60:02d}:{rest % 60:02d}.000Z"
        full = {"timestamp": stamp, "sessionId": self.sid, "cwd": "/work/app", **rec}
        self.rows.append((self.path, len(self.rows), json.dumps(full)))
        self.t += 1
        return self

    def raw(self, text):
        self.rows.append((self.path, len(self.rows), text))
        return self

    def human(self, text, **extra):
        return self.add(type="user", message={"role": "user", "content": text}, **extra)

    def call(self, mid=None, usage=None, blocks=(), model="big-1", **extra):
        message = {"model": model, "content": list(blocks)}
        if mid:
            message["id"] = mid
        if usage:
            message["usage"] = usage
        return self.add(type="assistant", message=message, **extra)

    def result(self, tid, body="ok", error=False, **extra):
        block = {"type": "tool_result", "tool_use_id": tid, "content": body, "is_error": error}
        return self.add(type="user", message={"content": [block]}, **extra)

    def compact(self, pre, dropped, trigger="auto", post=100):
        meta = {"trigger": trigger, "preTokens": pre, "postTokens": post, "cumulativeDroppedTokens": dropped}
        return self.add(type="system", subtype="compact_boundary", compactMetadata=meta)

    def steer(self):
        return self.add(type="attachment", attachment={"type": "queued_command"})


def tool(name, tid, **inp):
    return {"type": "tool_use", "id": tid, "name": name, "input": inp}


def use(cr=0, out=0, inp=0, cc=None, c5=0, c1h=0, think=0, speed=None):
    u = {
        "input_tokens": inp, "cache_read_input_tokens": cr, "output_tokens": out,
        "cache_creation": {"ephemeral_5m_input_tokens": c5, "ephemeral_1h_input_tokens": c1h},
        "output_tokens_details": {"thinking_tokens": think},
    }
    if cc is not None:
        u["cache_creation_input_tokens"] = cc
    if speed:
        u["speed"] = speed
    return u
