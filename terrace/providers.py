"""Models behind one interface; the offline one is deterministic and needs nothing."""

from __future__ import annotations

import hashlib
import json
import re
import time
from collections import Counter
from dataclasses import dataclass, field

import numpy as np


class Provider:
    """What the engine asks of a model.  Instances are sent to executors."""

    model_id: str

    def generate(self, prompt: str, schema: str, system: str = "") -> dict:
        raise NotImplementedError

    def embed(self, texts: list[str], task: str) -> list[list[float]]:
        raise NotImplementedError

    def summary(self, prompt: str) -> tuple[str, str]:
        out = self.generate(prompt, "summary")
        return out["title"].strip(), out["summary"].strip()


def _tokens(text: str) -> list[str]:
    return re.findall(r"\w+", text.lower())


@dataclass
class OfflineProvider(Provider):
    """Hashed bags of words and rule-made records."""

    dim: int = 64
    model_id: str = "offline-64"

    def embed(self, texts, task):
        out = np.zeros((len(texts), self.dim))
        for row, text in zip(out, texts):
            for t in _tokens(text or "(empty)"):
                h = int.from_bytes(hashlib.blake2b(t.encode(), digest_size=8).digest(), "big")
                row[h % self.dim] += 1 if h >> 63 else -1
        return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)).tolist()

    def generate(self, prompt, schema, system=""):
        if schema == "summary":
            words = [w for w, _ in Counter(w for w in _tokens(prompt) if len(w) > 3).most_common(4)]
            return {"title": " ".join(words) or "empty", "summary": prompt[:400]}
        if schema == "extraction":
            names = list(dict.fromkeys(re.findall(r"\b[A-Z][a-z]+(?: [A-Z][a-z]+)*", prompt)))[:12]
            pairs = zip(names, names[1:])
            return {
                "entities": [{"name": n, "type": "concept", "description": f"{n} in the text"} for n in names],
                "relationships": [{"source": a, "target": b, "type": "near", "description": f"{a} before {b}", "strength": 5} for a, b in pairs],
            }
        if schema == "rerank":
            return {"relevant_ids": re.findall(r"\[([CS]\d+)\]", prompt)}
        if schema == "resolution":
            return {"merges": []}
        if schema == "answer":
            labels = re.findall(r"^\[([CERS]\d+)\]", prompt, re.M)[:3]
            return {"answer": " ".join(f"[{x}]" for x in labels) or "nothing", "claims": [{"claim": "see sources", "citations": labels}]}
        if schema == "fact_check":
            return {"verdicts": [{"claim_index": 0, "verdict": "SUPPORTED", "note": ""}], "final_answer": ""}
        if schema == "dataset":
            return {"name": "", "description": "", "columns": []}
        raise ValueError(schema)


@dataclass
class HttpProvider(Provider):
    """A JSON-over-HTTP model server: POST {url}/generate and {url}/embed.

    Calls are spaced by ``per_minute`` per task and repeated with a growing
    pause, or the pause that the server names; vectors are cut to ``dim`` and normalised."""

    url: str
    model_id: str
    dim: int
    per_minute: int = 60
    batch: int = 32
    attempts: int = 6
    timeout: float = 900.0
    _sent: list = field(default_factory=list)

    def _post(self, path: str, body: dict) -> dict:
        import urllib.error
        import urllib.request

        for attempt in range(self.attempts):
            now = time.monotonic()
            self._sent[:] = [t for t in self._sent if now - t < 60]
            if len(self._sent) >= self.per_minute:
                time.sleep(60 - (now - self._sent[0]))
            self._sent.append(time.monotonic())
            request = urllib.request.Request(f"{self.url}/{path}", json.dumps(body | {"model": self.model_id}).encode(), {"Content-Type": "application/json"})
            try:
                with urllib.request.urlopen(request, timeout=self.timeout) as answer:
                    return json.load(answer)
            except (urllib.error.URLError, TimeoutError) as e:
                if attempt + 1 == self.attempts:
                    raise
                named = getattr(e, "headers", None) and e.headers.get("Retry-After")
                time.sleep(min(60.0, float(named) if named else 2.0**attempt))
        raise AssertionError

    def generate(self, prompt, schema, system=""):
        return self._post("generate", {"prompt": prompt, "schema": schema, "system": system})

    def embed(self, texts, task):
        out = []
        for at in range(0, len(texts), self.batch):
            found = self._post("embed", {"texts": [t if t and t.strip() else "(empty)" for t in texts[at : at + self.batch]], "task": task})["vectors"]
            for v in found:
                if len(v) < self.dim:
                    raise ValueError(f"the model gives {len(v)} dimensions, {self.dim} are needed")
                x = np.array(v[: self.dim])
                out.append((x / max(float(np.linalg.norm(x)), 1e-12)).tolist())
        return out
