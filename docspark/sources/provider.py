"""Embedding provider behind HTTP, and the text forms of targets."""

from __future__ import annotations

import json
import urllib.request
from typing import NamedTuple


def base_url(text: str) -> str:
    """Without white space around and slashes at the end; http unless a scheme is given."""
    url = text.strip().rstrip("/")
    return url if url.startswith(("http://", "https://")) else f"http://{url}"


def model_dims(spec: str) -> tuple[str, int]:
    """`model:dims`, split at the last colon; both parts must be there and dims positive."""
    model, colon, dims = spec.rpartition(":")
    if not colon or not model or not dims.isdecimal() or int(dims) == 0:
        raise ValueError(f"expected model:dims, got {spec!r}")
    return model, int(dims)


class Agent(NamedTuple):
    id: str
    domain: str
    url: str


def agent(text: str) -> Agent:
    """`id,domain,url`; none may be blank."""
    fields = [f.strip() for f in text.split(",", 2)]
    if len(fields) != 3 or not all(fields):
        raise ValueError(f"expected id,domain,url, got {text!r}")
    return Agent(fields[0], fields[1], fields[2].rstrip("/"))


class HttpProvider:
    """Sends batches to /v1/embeddings; picklable, so tasks carry it.

    `prefix` goes before every text, as some models want one for documents and
    another for queries.
    """

    def __init__(self, url: str, model: str, prefix: str = "", timeout: float = 120.0):
        self.url, self.model, self.prefix, self.timeout = base_url(url), model, prefix, timeout

    def _call(self, path: str, body: dict | None = None) -> dict:
        data = None if body is None else json.dumps(body).encode()
        request = urllib.request.Request(self.url + path, data, {"Content-Type": "application/json"})
        with urllib.request.urlopen(request, timeout=self.timeout) as r:  # noqa: S310  the scheme is http or https
            return json.load(r)

    def embed(self, texts: list[str]) -> list[list[float]]:
        """Vectors in the order of the texts, whatever the order of the reply."""
        if not texts:
            return []
        reply = self._call("/v1/embeddings", {"model": self.model, "input": [self.prefix + t for t in texts]})
        got = {int(x["index"]): x["embedding"] for x in reply["data"]}
        if not set(got) <= set(range(len(texts))):
            raise ValueError("the reply holds an index out of range")
        if len(got) < len(texts):
            raise ValueError("the reply leaves out a text")
        return [got[i] for i in range(len(texts))]

    def healthy(self) -> bool:
        try:
            self._call("/api/tags")
        except OSError:
            return False
        return True

    def identity(self) -> str:
        """Digest of the model, listed under its name, its base name or as :latest."""
        listed = [(m["name"], m["digest"]) for m in self._call("/api/tags")["models"] if m.get("digest")]
        exact = dict(listed)
        bases: dict[str, str] = {}
        for name, digest in listed:
            bases.setdefault(name.split(":", 1)[0], digest)
        for digest in (exact.get(self.model), bases.get(self.model), exact.get(f"{self.model}:latest")):
            if digest:
                return digest
        raise LookupError(f"no digest of model {self.model!r}")
