"""The YAML document that describes a pipeline, read into plain dataclasses.

Channel and fork sizes are accepted and have no meaning here: Spark decides
parallelism and applies back-pressure.  Unknown plugin types are errors.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field
from typing import Any

from ..operators import filters as _filters
from ..operators import parse as _parse  # noqa: F401  registers the parser
from ..operators.concat import ConcatRule
from ..sources.sinks import WRITERS, Sink

SIZES = {"async_out_chan_size", "sync_out_chan_size", "out_buf_len", "reenter_chan_len", "fork", "forks", "nfork", "out_chan_size", "internal_chan_size", "internal_buf_size", "discard_chan_size", "sender_inchan_size", "journal_out_chan_len", "commit_id_chan_len", "child_data_chan_len", "child_id_chan_len", "lb_key"}
SINK_KINDS = {"es", "kafka", "fluentd", "stdout", "http", "parquet", "json", "noop", "memory"}


def append_env(tags: list[str], env: str) -> list[str]:
    return [f"{t}.{env}" for t in tags]


def replace_env(x: Any, env: str) -> Any:
    """``{env}`` replaced in texts, lists and the keys and values of maps."""
    if isinstance(x, str):
        return x.replace("{env}", env)
    if isinstance(x, list):
        return [replace_env(v, env) for v in x]
    return {replace_env(k, env): replace_env(v, env) for k, v in x.items()} if isinstance(x, dict) else x


def parse_add(cfg: dict | None, env: str) -> dict[str, list[dict]]:
    """Per tag a list of maps; a plain map counts as a list of one."""
    out = {}
    for tag, rules in (cfg or {}).items():
        if not isinstance(rules, (list, dict)):
            raise ValueError(f"add rules of {tag} must be a list of maps")
        out[replace_env(tag, env)] = rules if isinstance(rules, list) else [rules]
    return out


@dataclass
class Receiver:
    name: str
    kind: str
    options: dict


@dataclass
class PipelineSpec:
    env: str
    receivers: list[Receiver] = field(default_factory=list)
    acceptor: list[_filters.Filter] = field(default_factory=list)
    throttle_per_sec: int | None = None
    throttle_max: int = 10_000
    concat: dict[str, ConcatRule] = field(default_factory=dict)
    concat_max_len: int = 300_000
    concat_wait_sec: float = 3.0
    tag_concat: dict[str, ConcatRule] = field(default_factory=dict)
    tag_concat_max_len: int = 300_000
    tag_concat_wait_sec: float = 5.0  # fixed for rules among the tag filters
    tag_filters: list[_filters.Filter] = field(default_factory=list)
    post: list[_filters.Filter] = field(default_factory=list)
    sinks: list[Sink] = field(default_factory=list)
    journal_path: str | None = None
    host_key: str = "local"


def _active(p: dict, env: str) -> bool:
    return "active_env" not in p or env in p["active_env"]


def _plugins(section: dict | None) -> list[tuple[str, dict]]:
    return list(((section or {}).get("plugins") or {}).items())


def _unknown(what: str, name: str, kind: Any) -> ValueError:
    return ValueError(f"{what} {name!r} has the unknown type {kind!r}")


def _registered(what: str, name: str, kind: Any):
    """The factory of a filter type that ``filters.register`` has added."""
    if kind not in _filters.FACTORIES:
        raise _unknown(what, name, kind)
    return _filters.FACTORIES[kind]


def _concat_rules(cfg: dict | None, env: str) -> dict[str, ConcatRule]:
    return {f"{t}.{env}": ConcatRule(r["msg_key"], r["identifier"], r.get("head_regexp") or r["regex"]) for t, r in (cfg or {}).items()}


def load(doc: dict | str, env: str, host: str = "localhost") -> PipelineSpec:
    """Compile a document (a map, or a path to YAML) for one environment."""
    if isinstance(doc, str):
        import yaml

        with open(doc, encoding="utf-8") as f:
            doc = yaml.safe_load(f)
    s = doc.get("settings", doc)
    spec = PipelineSpec(env, host_key=f"{host}-{env}")
    ignored: set[str] = set()

    def clean(p: dict) -> dict:
        ignored.update(SIZES & p.keys())
        return {k: v for k, v in p.items() if k not in SIZES and k not in ("type", "active_env")}

    for name, p in _plugins((s.get("acceptor") or {}).get("recvs")):
        if not _active(p, env):
            continue
        if p.get("type") not in ("fluentd", "rsyslog", "http", "kafka"):
            raise _unknown("receiver", name, p.get("type"))
        options = clean(p)
        if p["type"] == "fluentd":
            spec.concat.update(_concat_rules(options.pop("concat", None), env))
            spec.concat_max_len = int(options.get("concat_max_len", spec.concat_max_len))
            spec.concat_wait_sec = float(options.get("concat_with_sec", spec.concat_wait_sec))
        if p["type"] == "kafka":
            options = {k: v[env] if isinstance(v, dict) and k in ("brokers", "topics", "groups", "tags") else v for k, v in options.items()}
            options["add"] = parse_add(options.get("add"), env)
            if options.get("rewrite_tag"):
                options["rewrite_tag"] = f"{options['rewrite_tag']}.{env}"
        spec.receivers.append(Receiver(name, p["type"], replace_env(options, env) if p["type"] == "rsyslog" else options))

    accept, last = s.get("acceptor_filters") or {}, None
    clean(accept)
    if accept.get("is_throttle"):
        per_sec, most = int(accept.get("throttle_per_sec", 0)), int(accept.get("throttle_max", 0))
        spec.throttle_per_sec = per_sec if per_sec > 0 else 1000
        spec.throttle_max = most if most > 0 else spec.throttle_max
    for name, p in _plugins(accept):
        kind = p.get("type", "default" if name == "default" else None)
        o = clean(p)
        if kind == "default":
            last = _filters.accept(o.get("remove_empty_tag", False), o.get("remove_unknown_tag", False), replace_env(o.get("accept_tags", []), env), parse_add(o.get("add"), env))
        elif kind == "spark":
            spec.acceptor.append(_filters.ignore_lines(f"spark.{env}", o["msg_key"], o["identifier"], o["ignore_regex"]))
        elif kind == "spring":
            rules = [(replace_env(r["new_tag"], env), r["regexp"]) for r in o["rules"]]
            spec.acceptor.append(_filters.retag(f"spring.{env}", rules, o.get("msg_key", "log"), o.get("tag_key", "tag")))
        else:
            spec.acceptor.append(_registered("acceptor filter", name, kind)(**replace_env(o, env)))
    if last is not None:  # always after the others
        spec.acceptor.append(last)

    spec.journal_path = (s.get("journal") or {}).get("buf_dir_path")

    for name, p in _plugins(s.get("tag_filters")):
        if p.get("type") == "concator":
            spec.tag_concat.update(_concat_rules(p.get("plugins"), env))
            spec.tag_concat_max_len = int((p.get("config") or {}).get("max_length", spec.tag_concat_max_len))
            continue
        o = clean(p)
        if p.get("type") != "parser":  # a registered one gets its settings as they are
            spec.tag_filters.append(_registered("tag filter", name, p.get("type"))(**o))
            continue
        if isinstance(o.get("append_time_zone"), dict):
            o["append_time_zone"] = o["append_time_zone"].get(env, "")
        if not o.get("msg_key"):
            warnings.warn(f"parser {name!r} has no msg_key, so its pattern is never used", stacklevel=2)
        o["tags"], o["add"] = replace_env(o.get("tags", []), env), parse_add(o.get("add"), env)
        spec.tag_filters.append(_parse.parser(**o))

    first = None
    for name, p in _plugins(s.get("post_filters")):
        kind = p.get("type", "default" if name == "default" else None)
        o = clean(p)
        if kind == "default":
            first = _filters.clean(int(o.get("max_len", 0)), parse_add(o.get("add"), env))
        elif kind == "es-dispatcher":
            spec.post.append(_filters.lookup_retag(append_env(o["tags"], env), o["tag_key"], replace_env(o["rewrite_tag_map"], env)))
        elif kind == "tag-rewriter":
            spec.post.append(_filters.swap_env(f"{o['tag']}.{env}", o["tag_key"]))
        elif kind == "fields":
            spec.post.append(_filters.fields(append_env(o["tags"], env), o.get("include_fields") or (), o.get("exclude_fields") or (), o.get("new_fields")))
        elif kind == "custom-bigdata":
            spec.post.append(_filters.rowkey(append_env(o["tags"], env)))
        else:
            spec.post.append(_registered("post filter", name, kind)(**o))
    if first is not None:
        spec.post.insert(0, first)

    for name, p in _plugins(s.get("producer")):
        if not _active(p, env):
            continue
        kind = p.get("type")
        if kind not in SINK_KINDS and kind not in WRITERS:
            raise _unknown("sender", name, kind)
        o = clean(p)
        tags = o.pop("tags", [])
        tags = append_env(tags, env) if kind == "kafka" else tags if kind == "fluentd" else replace_env(tags, env)
        for k in ("brokers", "topic"):
            if isinstance(o.get(k), dict):
                o[k] = o[k][env]
        if isinstance(o.get("brokers"), list):
            o["brokers"] = ",".join(o["brokers"])
        if "indices" in o:
            o["indices"] = replace_env(o["indices"], env)
        on_error = "skip" if o.pop("is_discard_when_blocked", False) else "fail"
        spec.sinks.append(Sink(name, kind, tags, o, int(o.pop("msg_batch_size", 500)), bool(o.pop("dry", False)), on_error))
    if ignored:
        warnings.warn(f"ignored sizes: {', '.join(sorted(ignored))}", stacklevel=2)
    return spec
