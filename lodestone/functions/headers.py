"""Deterministic one-sentence descriptions of structured text."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable
from typing import Any

import yaml

SHOWN = 15
# Terraform's block kinds in the order that they are looked for.
TERRAFORM_BLOCKS = ("resource", "module", "data", "variable", "provider", "output")
# Root keys of a compose file that are not services; so are keys that start with x-.
COMPOSE_ROOTS = ("version", "volumes", "networks", "configs", "secrets", "x-", "services")
# Container keys and what a header says of them, in order.
CONTAINER_SAYS = (
    ("resources", "container CPU and memory requests and limits"),
    ("livenessProbe", "liveness probe"),
    ("readinessProbe", "readiness probe"),
    ("startupProbe", "startup probe"),
    ("env", "environment variables"),
    ("envFrom", "config map references"),
)
# Service keys of a compose file and what a header says of them, in order.
COMPOSE_SAYS = (("ports", "port mappings"), ("environment", "environment variables"), ("volumes", "mounted volumes"), ("depends_on", "service dependencies"))
# Names of formats in a fragment's header; others are capitalised.
LABELS = {"yaml": "YAML", "json": "JSON", "terraform": "Terraform", "puppet": "Puppet"}
# Fixed value: a key at the start of a line.
LINE_KEY = re.compile(r'^(?:\s*)(?:"([^"]+)"|([A-Za-z_][A-Za-z0-9_-]*))\s*:', re.MULTILINE)
# The library's parser in C, if it was built with one.
FAST = getattr(yaml, "CSafeLoader", None)
# Fixed value: brackets of a text that may go to it, and columns below for a line's indent: it knows no limit of depth.
DEPTH = 60
# Fixed value: what the two parsers don't read alike (tags, directives, tabs, marks of byte order, a
# block's mark that a comment touches) or may not.
ODD = re.compile(r"[^\r\n\x20-\x7e\xa0-\u2027\u202a-\ud7ff\ue000-\ufefe\uff00-\ufffd\U00010000-\U0010ffff]|[!%]|[|>][-+0-9]*#|^[ ?:-]{60}", re.MULTILINE)


def listing(names: Iterable[Any], rest: str = "others") -> str:
    """Up to SHOWN names, and how many more there are."""
    names = list(names)
    more = len(names) - SHOWN
    return ", ".join(names[:SHOWN]) + (f" and {more} {rest}" if more > 0 else "")


def at(data: Any, path: str) -> Any:
    """A nested value by dotted path; None where it breaks off."""
    for key in path.split("."):
        data = data.get(key) if isinstance(data, dict) else None
    return data


def mapping(data: Any, key: str) -> dict:
    """``data[key]`` if that is a mapping, else an empty one."""
    inner = data.get(key) if isinstance(data, dict) else None
    return inner if isinstance(inner, dict) else {}


def _attributes(names: list[str]) -> str:
    return f" Attributes: {listing(names, 'other attributes')}." if names else ""


def hcl_header(kind: str | None, name: str | None, attributes: list[str] | None = None) -> str:
    words = ["Terraform", *([kind] if kind else []), *([f'"{name}"'] if name else [])]
    return " ".join(words) + "." + _attributes(attributes or [])


def puppet_header(kind: str | None = None, name: str | None = None, parameters: list[str] | None = None, resources: list[str] | None = None, ordering: bool = False, includes: list[str] | None = None) -> str:
    says = []
    if parameters:
        says.append("parameters: " + listing(parameters))
    if resources:
        says.append("declares resources: " + ", ".join(sorted(set(resources))[:SHOWN]))
    if includes:
        says.append("includes: " + ", ".join(includes[:SHOWN]))
    if ordering:
        says.append("uses dependency chain ordering")
    head = f"Puppet {kind or 'block'}" + (f' "{name}"' if name else "")
    return head + (" with " + "; ".join(says) if says else "") + "."


# -- Kubernetes: each kind's features are functions of the manifest


def _workload(m: dict) -> list[str]:
    pod = at(m, "spec.template.spec")
    says = [w for k, w in (("replicas", "replica count"), ("strategy", "rollout strategy")) if at(m, f"spec.{k}") is not None]
    containers = at(pod, "containers")
    containers = [c for c in containers if isinstance(c, dict)] if isinstance(containers, list) else []
    says += [w for k, w in CONTAINER_SAYS if any(c.get(k) for c in containers)]
    return says + [w for k, w in (("volumes", "mounted volumes"), ("affinity", "pod affinity rules"), ("serviceAccountName", "service account")) if at(pod, k) is not None]


def _autoscaler(m: dict) -> list[str]:
    says = [w for k, w in (("minReplicas", "minimum replica count"), ("maxReplicas", "maximum replica count")) if at(m, f"spec.{k}") is not None]
    metrics = at(m, "spec.metrics")
    if isinstance(metrics, list) and metrics:
        names = sorted({str(n) for x in metrics if (n := at(x, "resource.name"))})
        says.append(f"autoscaling on {', '.join(names)} metrics" if names else "autoscaling metrics")
    return says


def _service(m: dict) -> list[str]:
    kind, ports = at(m, "spec.type"), at(m, "spec.ports")
    says = [f"type {'ClusterIP' if kind is None else kind}"]
    return says + ([f"{len(ports)} exposed port(s)"] if isinstance(ports, list) and ports else [])


def _keys(m: dict) -> list[str]:
    keys = list(mapping(m, "data"))
    return ["keys: " + listing(keys)] if keys else []


def _ingress(m: dict) -> list[str]:
    rules = at(m, "spec.rules")
    hosts = [r["host"] for r in rules if isinstance(r, dict) and r.get("host")] if isinstance(rules, list) else []
    return ["hostnames " + ", ".join(hosts[:3])] if hosts else []


def _scheduled(m: dict) -> list[str]:
    when = at(m, "spec.schedule")
    return [f"schedule {when}"] if when else []


KINDS: dict[str, Callable[[dict], list[str]]] = {
    **dict.fromkeys(("deployment", "statefulset", "daemonset"), _workload),
    "horizontalpodautoscaler": _autoscaler,
    "service": _service,
    **dict.fromkeys(("configmap", "secret"), _keys),
    "ingress": _ingress,
    **dict.fromkeys(("cronjob", "job"), _scheduled),
}


def k8s_header(main: dict, context: dict) -> str:
    kind = main.get("kind") or context.get("kind", "resource")
    meta = main["metadata"] if isinstance(main.get("metadata"), dict) else mapping(context, "metadata")
    head = f'Kubernetes {kind} "{meta.get("name", "<unnamed>")}"'
    if meta.get("namespace"):
        head += f' in namespace "{meta["namespace"]}"'
    says = KINDS.get((kind or "").lower(), lambda m: [])(main)
    return head + "." + (f" Configures: {', '.join(says)}." if says else "")


def is_compose(data: dict) -> bool:
    bodies = [s for s in mapping(data, "services").values() if isinstance(s, dict)]
    scaled = any(k in s for s in bodies for k in ("replicaCount", "replicas"))
    return not scaled and any(k in s for s in bodies for k in ("image", "build"))


def compose_header(main: dict, context: dict) -> str:
    own = mapping(main, "services") or {str(k): v for k, v in main.items() if str(k) not in COMPOSE_ROOTS and not str(k).startswith("x-")}
    services: dict[str, dict] = {}
    for k, v in [*own.items(), *mapping(context, "services").items()]:
        if isinstance(v, dict):
            services.setdefault(k, v)
    if not services:
        return "Docker Compose configuration fragment."
    says = [w for k, w in COMPOSE_SAYS if any(s.get(k) for s in services.values())]
    return f"Docker Compose configuration with services: {listing(services)}" + (f". Defines {', '.join(says)}" if says else "") + "."


def helm_header(main: dict, context: dict) -> str:
    names = list(dict.fromkeys([*mapping(main, "services"), *(k for k in main if k != "services"), *context]))
    return f"Helm values for components: {listing(names)}." if names else "Helm values configuration."


def generic_header(main: dict) -> str:
    return f"YAML configuration with top-level keys: {listing(main)}." if main else "YAML configuration with no top-level keys."


def yaml_documents(text: str) -> list:
    """What ``yaml.safe_load_all`` reads: by the parser in C where both read alike. What that one
    refuses goes to the other, whose word stands."""
    if FAST and text.count("[") + text.count("{") <= DEPTH and not ODD.search(text):
        try:
            return list(yaml.load_all(text, Loader=FAST))
        except Exception:
            pass
    return list(yaml.safe_load_all(text))


def yaml_header(text: str, doc_type: str | None = None) -> str:
    docs = [d for d in yaml_documents(text) if d is not None]
    main = max(docs, key=lambda d: len(str(d)), default=None)
    if not isinstance(main, dict):
        return fallback_header(text, "yaml")
    context: dict = {}
    for k, v in [kv for d in docs if d is not main and isinstance(d, dict) for kv in d.items()]:
        context.setdefault(k, v)
    told = {"kubernetes_manifest": k8s_header, "docker_compose": compose_header, "helm_values": helm_header}.get(doc_type or "")
    if told:
        return told(main, context)
    if (main.get("kind") or context.get("kind")) and ("apiVersion" in main or "apiVersion" in context):
        return k8s_header(main, context)
    return compose_header(main, context) if is_compose(main) else generic_header(main)


def json_header(text: str, terraform: bool = False) -> str:
    data = json.loads(text)
    if isinstance(data, dict):
        block = next((b for b in TERRAFORM_BLOCKS if b in data), None) if terraform else None
        return terraform_json_header(block, data[block]) if block else f"JSON object with keys: {listing(data)}."
    return f"JSON array with {len(data)} element(s)." if isinstance(data, list) else "JSON scalar value."


def terraform_json_header(block: str, body: Any) -> str:
    if not isinstance(body, dict):
        return f"Terraform {block} block."
    kind, inner = next(iter(body.items()), (None, None))
    name, attributes = next(iter(inner.items()), (None, None)) if isinstance(inner, dict) else (None, None)
    words = [f"Terraform {block}", *([kind] if kind else []), *([f'"{name}"'] if name else [])]
    return " ".join(words) + "." + _attributes(list(attributes) if isinstance(attributes, dict) else [])


def fallback_header(text: str, fmt: str) -> str:
    keys: dict[str, None] = {}
    for m in LINE_KEY.finditer(text):
        keys[m[1] or m[2]] = None
        if len(keys) >= SHOWN:
            break
    label = LABELS.get(fmt, fmt.capitalize())
    return f"{label} configuration fragment" + (f" with keys: {', '.join(keys)}" if keys else "") + "."


def header(fmt: str, text: str, doc_type: str | None = None) -> str:
    """Description of a chunk of YAML, JSON or Terraform's JSON; a fragment's for all else and for
    what does not parse."""
    try:
        if fmt == "yaml":
            return yaml_header(text, doc_type)
        if fmt in ("json", "terraform"):
            return json_header(text, fmt == "terraform")
    except Exception:  # whatever a parser objects to, the text still gets a header
        pass
    return fallback_header(text, fmt)
