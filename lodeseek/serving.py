"""Thin adapters: request dictionaries in, response dictionaries out."""

from __future__ import annotations

from typing import Any

import numpy as np
from pyspark.sql import DataFrame

from .functions.embed import DOCUMENT_PREFIX, QUERY_PREFIX, Embedder, base64_vector
from .operators import search as ops
from .schema import KINDS, TOP_HTTP, TOP_MCP

#: Inputs a request, open probes, protocol version.
MOST_INPUTS, OPEN_PATHS, PROTOCOL = 2048, ("/health", "/v1/models"), "2024-11-05"


class Failure(Exception):
    def __init__(self, status: int, message: str):
        super().__init__(message)
        self.status, self.message = status, message


def words(texts: list[str]) -> int:
    return sum(max(1, len([w for w in t.replace("\n", " ").replace("\t", " ").split(" ") if w])) for t in texts)


def _hits(chunks: DataFrame, embedder: Embedder, query: str, top_k: int, filters: dict[str, Any]) -> list[dict]:
    vector = embedder.embed([QUERY_PREFIX + query])[0].tolist()
    kinds = {k for k in filters.get("kinds") or () if k in KINDS}
    kinds |= {"scan"} if "text" in kinds else set()
    found = ops.search(chunks, vector, top_k, frozenset(kinds), filters.get("folder"), (filters.get("ext") or "").removeprefix("."), filters.get("since"))
    rows = sorted((r.asDict() for r in found.collect()), key=lambda r: (-r["score"], r["path"]))  # top_k rows
    return [r | {"score": min(1.0, max(0.0, r["score"]))} for r in rows]


def search(body: dict, chunks: DataFrame, embedder: Embedder) -> dict:
    query = body.get("query")
    if not isinstance(query, str) or not query.strip():
        raise Failure(400, "query must be a string with text")
    top_k = min(200, max(1, int(body.get("top_k", TOP_HTTP))))
    return {"results": _hits(chunks, embedder, query, top_k, body.get("filters") or {})}


def rpc(message: dict, chunks: DataFrame, embedder: Embedder) -> dict | None:
    """A JSON-RPC call of a tool protocol: initialize, ping, tools/list, tools/call of ``search``."""
    method, params, number = message.get("method"), message.get("params") or {}, message.get("id")
    answer = lambda result: {"jsonrpc": "2.0", "id": number, "result": result}
    if method == "initialize":
        return answer({"protocolVersion": params.get("protocolVersion", PROTOCOL), "capabilities": {"tools": {}}, "serverInfo": {"name": "lodeseek", "version": "1"}})
    if method == "ping":
        return answer({})
    if method == "tools/list":
        properties = {"query": {"type": "string"}, "top_k": {"type": "integer"}, "kinds": {"type": "array", "items": {"type": "string"}}, "folder": {"type": "string"}}
        return answer({"tools": [{"name": "search", "description": "Search files by meaning", "inputSchema": {"type": "object", "properties": properties, "required": ["query"]}}]})
    if method == "tools/call" and params.get("name") == "search":
        given = params.get("arguments") or {}
        rows = _hits(chunks, embedder, given.get("query", ""), min(50, max(1, int(given.get("top_k", TOP_MCP)))), {k: given.get(k) for k in ("kinds", "folder")})
        return answer({"content": [{"type": "text", "text": "\n".join(f"{r['path']} ({r['score']:.3f})" for r in rows)}], "structuredContent": {"results": rows}})
    if number is None:
        return None
    return {"jsonrpc": "2.0", "id": number, "error": {"code": -32601, "message": f"no method {method}"}}


def _vectors(texts: Any, embedder: Embedder, dimensions: int | None, as_query: bool) -> tuple[list[str], np.ndarray]:
    texts = [texts] if isinstance(texts, str) else texts
    if not isinstance(texts, list) or not texts or not all(isinstance(t, str) for t in texts):
        raise Failure(400, "input must be a string or a list of strings")
    if len(texts) > MOST_INPUTS:
        raise Failure(400, f"at most {MOST_INPUTS} inputs")
    if dimensions not in (None, embedder.dim):
        raise Failure(400, f"only {embedder.dim} dimensions")
    return texts, embedder.embed([(QUERY_PREFIX if as_query else DOCUMENT_PREFIX) + t for t in texts])


def openai_embeddings(body: dict, embedder: Embedder) -> dict:
    kind = body.get("encoding_format", "float")
    if kind not in ("float", "base64"):
        raise Failure(400, "encoding_format must be float or base64")
    texts, vectors = _vectors(body.get("input"), embedder, body.get("dimensions"), "query" in str(body.get("task", "")))
    write = base64_vector if kind == "base64" else lambda v: v.tolist()
    n = words(texts)
    return {"object": "list", "model": body.get("model", ""), "data": [{"object": "embedding", "index": i, "embedding": write(v)} for i, v in enumerate(vectors)], "usage": {"prompt_tokens": n, "total_tokens": n}}


def cohere_embeddings(body: dict, embedder: Embedder, version: int = 2) -> dict:
    types = body.get("embedding_types") or ["float"]
    if types != ["float"]:
        raise Failure(400, "only float embeddings")
    texts, vectors = _vectors(body.get("texts"), embedder, body.get("output_dimension"), body.get("input_type") == "search_query")
    shape = {"float": vectors.tolist()} if version == 2 or body.get("embedding_types") else vectors.tolist()
    return {"embeddings": shape, "texts": texts, "meta": {"billed_units": {"input_tokens": words(texts)}}}


def gemini_embeddings(body: dict, embedder: Embedder) -> dict:
    def one(request: dict) -> list[float]:
        text = "".join(p.get("text", "") for p in (request.get("content") or {}).get("parts", []))
        return _vectors(text, embedder, request.get("outputDimensionality"), request.get("taskType") == "RETRIEVAL_QUERY")[1][0].tolist()

    if "requests" in body:
        return {"embeddings": [{"values": one(r)} for r in body["requests"]]}
    return {"embedding": {"values": one(body)}}


def authorised(path: str, headers: dict[str, str], query: dict[str, str], token: str | None) -> bool:
    """Probes are open; otherwise the token must come as bearer, API key header or ``key``."""
    if path in OPEN_PATHS or token is None:
        return True
    low = {k.lower(): v for k, v in headers.items()}
    return token in (low.get("authorization", "").removeprefix("Bearer "), low.get("x-goog-api-key"), query.get("key"))


def error(path: str, failure: Failure) -> dict:
    """The error in the shape that the path's clients expect."""
    if "v1beta" in path:
        return {"error": {"code": failure.status, "message": failure.message, "status": "INVALID_ARGUMENT"}}
    if path.endswith("/embed"):
        return {"message": failure.message}
    return {"error": {"message": failure.message, "type": "invalid_request_error"}}
