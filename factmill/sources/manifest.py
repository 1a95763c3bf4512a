"""Job manifests and analysis requests: reading, defaults, validation on the driver.

These are one small record each; the routes of a request become a DataFrame.
"""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factmill.functions.names import action_key

# Fixed values of the two JSON contracts.
CONTRACT_VERSION = "v2"
FEATURES = ("http_status", "request_usage", "resource_usage", "with_pivot", "attribute_make", "scopes_used", "polymorphic", "broadcast_channels")


class InvalidInput(ValueError):
    """A manifest or request that breaks a rule; ``cause`` is the underlying message, if any."""

    def __init__(self, message: str, cause: str | None = None):
        super().__init__(message)
        self.cause = cause


@dataclass
class Manifest:
    root: str
    targets: list[str] = field(default_factory=lambda: ["app", "routes"])
    vendor_whitelist: list[str] = field(default_factory=list)
    max_workers: int | None = None
    max_files: int | None = None
    max_depth: int | None = None
    cache_enabled: bool = False
    cache_kind: str = "sha256+mtime"
    features: dict[str, bool] = field(default_factory=lambda: dict.fromkeys(FEATURES, True))


def parse_manifest(data: dict[str, Any]) -> Manifest:
    """A manifest from its JSON object; unknown keys don't matter, missing ones take their defaults."""
    try:
        project = data["project"]
        root = project["root"]
    except (KeyError, TypeError) as e:
        raise InvalidInput("failed to decode manifest", f"missing field {e}") from None
    if not isinstance(root, str):
        raise InvalidInput("failed to decode manifest", "project.root must be a string")
    scan, limits, cache, features = (data.get(k) or {} for k in ("scan", "limits", "cache", "features"))
    kind = "mtime" if cache.get("kind") == "mtime" else "sha256+mtime"
    return Manifest(
        root,
        list(scan.get("targets", ["app", "routes"])),
        list(scan.get("vendor_whitelist") or []),
        limits.get("max_workers"),
        limits.get("max_files"),
        limits.get("max_depth"),
        bool(cache.get("enabled", False)),
        kind,
        {f: bool(features.get(f, True)) for f in FEATURES},
    )


def resolve_root(manifest: Manifest, source: str | None) -> None:
    """Absolute roots and those that exist from here stay; others are relative to the manifest's folder."""
    if source is None or os.path.isabs(manifest.root) or os.path.exists(manifest.root):
        return
    manifest.root = str(Path(source).parent / manifest.root)


def validate_manifest(manifest: Manifest) -> None:
    if not manifest.root:
        raise InvalidInput("project.root cannot be empty")
    if not os.path.exists(manifest.root):
        raise InvalidInput(f'project root path does not exist: "{manifest.root}"')
    if not os.path.isdir(manifest.root):
        raise InvalidInput(f'project root must be a directory, got file: "{manifest.root}"')


def load_manifest(text: str, source: str | None = None) -> Manifest:
    try:
        data = json.loads(text)
    except ValueError as e:
        raise InvalidInput("failed to decode manifest", str(e)) from None
    manifest = parse_manifest(data)
    resolve_root(manifest, source)
    validate_manifest(manifest)
    return manifest


@dataclass
class Request:
    request_id: str
    fingerprint: str
    manifest: Manifest
    routes: list[dict[str, Any]]
    version: str = CONTRACT_VERSION


# Allowed keys of the closed-world parts, with those that must be there.
_REQUEST = {"contractVersion": True, "requestId": True, "runtimeFingerprint": True, "manifest": True, "runtime": True}
_RUNTIME = {"app": True, "packages": False, "routes": True}
_APP = {"basePath": True, "laravelVersion": True, "phpVersion": True, "appEnv": True}
_ROUTE = {k: k in ("routeId", "methods", "uri", "middleware", "where", "defaults", "bindings", "action") for k in ("routeId", "methods", "uri", "domain", "name", "prefix", "middleware", "where", "defaults", "bindings", "action")}
_ACTION = {"kind": True, "fqcn": False, "method": False}
_BINDING = {"parameter": True, "kind": True, "targetFqcn": False, "isImplicit": True}
_PACKAGE = {"name": True, "version": False}


def _closed(data: Any, keys: dict[str, bool], where: str) -> dict[str, Any]:
    if not isinstance(data, dict):
        raise InvalidInput("failed to decode analysis request", f"{where} must be an object")
    if unknown := sorted(set(data) - set(keys)):
        raise InvalidInput("failed to decode analysis request", f"unknown field `{unknown[0]}` in {where}")
    if missing := [k for k, needed in keys.items() if needed and k not in data]:
        raise InvalidInput("failed to decode analysis request", f"missing field `{missing[0]}` in {where}")
    return data


def load_request(text: str, source: str | None = None) -> Request:
    """A request from its JSON text, normalised and checked: known keys, version, base path, unique route ids."""
    try:
        data = _closed(json.loads(text), _REQUEST, "request")
    except InvalidInput:
        raise
    except ValueError as e:
        raise InvalidInput("failed to decode analysis request", str(e)) from None
    version = data["contractVersion"]
    if not isinstance(version, str) or version.rsplit(".", 1)[-1] != CONTRACT_VERSION:
        raise InvalidInput("analysis request validation failed: unsupported contractVersion")
    runtime = _closed(data["runtime"], _RUNTIME, "runtime")
    app = _closed(runtime["app"], _APP, "runtime.app")
    for package in runtime.get("packages") or []:
        _closed(package, _PACKAGE, "package")
    manifest = parse_manifest(data["manifest"])
    resolve_root(manifest, source)
    if not os.path.isabs(app["basePath"]):
        raise InvalidInput("runtime.app.basePath must be an absolute path")
    if Path(app["basePath"]) != Path(manifest.root):
        raise InvalidInput("runtime.app.basePath must match manifest.project.root after normalization")
    seen: set[str] = set()
    for route in runtime["routes"]:
        _closed(route, _ROUTE, "route")
        action = _closed(route["action"], _ACTION, "action")
        for binding in route["bindings"] or []:
            _closed(binding, _BINDING, "binding")
        if action["kind"] == "invokable_controller" and action.get("method") is None:
            action["method"] = "__invoke"
        if route["routeId"] in seen:
            raise InvalidInput(f'runtime.routes contains duplicate routeId "{route["routeId"]}"')
        seen.add(route["routeId"])
    validate_manifest(manifest)
    return Request(data["requestId"], data["runtimeFingerprint"], manifest, runtime["routes"], version)


ROUTES = "route_id string, pos int, methods array<string>, uri string, domain string, name string, prefix string, middleware array<string>, action_kind string, action_fqcn string, action_method string, where string, defaults string, bindings string"


def routes_table(spark: SparkSession, request: Request, project_id: str) -> DataFrame:
    """The request's routes with their action keys, one row per route in order; where, defaults and bindings as JSON."""
    rows = [
        (r["routeId"], i, r["methods"], r["uri"], r.get("domain"), r.get("name"), r.get("prefix"), r["middleware"], r["action"]["kind"], r["action"].get("fqcn"), r["action"].get("method"), *(json.dumps(r[k], sort_keys=True) for k in ("where", "defaults", "bindings")))
        for i, r in enumerate(request.routes)
    ]
    key = action_key(F.col("action_kind"), F.col("action_fqcn"), F.col("action_method"))
    return spark.createDataFrame(rows, ROUTES).select(F.lit(project_id).alias("project_id"), "*", key.alias("action_key"))
