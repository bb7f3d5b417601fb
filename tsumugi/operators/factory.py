"""Tokenizers from settings: plugins by name, with room for one's own.

A maker takes the plugin's options (keys without regard to case) and the dictionary, and returns keyword arguments of
`Tokenizer`, or changes the dictionary's connection costs. Names may carry the package they came with.
"""

from __future__ import annotations

from collections.abc import Callable

from ..sources import definitions
from .dictionary import Dictionary
from .tokenize import Tokenizer

KINDS = ("input text", "unknown words", "path rewriting", "connection cost")
_MAKERS: dict[str, dict[str, Callable]] = {k: {} for k in KINDS}


def register(kind: str, name: str, maker: Callable[[dict, Dictionary], dict]) -> None:
    _MAKERS[kind][name] = maker


def _read(path: str | None) -> str | None:
    if not path:
        return None
    with open(path, encoding="utf-8") as f:
        return f.read()


def _known(d: Dictionary, pos) -> tuple[str, ...]:
    pos = tuple(pos)
    if len(pos) != 6:
        raise ValueError(f"part of speech {pos}")
    return pos


def _default_text(o: dict, d: Dictionary) -> dict:
    text = _read(o.get("rewritedef"))
    if text is None:
        return {"normalize": True}
    keep, replace = definitions.rewrite_rules(text)
    return {"normalize": True, "keep": keep, "replace": replace}


def _mecab(o: dict, d: Dictionary) -> dict:
    out: dict = {"oov": ("mecab",)}
    chars, unknown = _read(o.get("chardef")), _read(o.get("unkdef"))
    if chars is not None:
        out["properties"] = definitions.char_properties(chars)
    if unknown is not None:
        out["unknown"] = definitions.unknown_words(unknown, out.get("properties", definitions.PROPERTIES))
    return out


def _inhibit(o: dict, d: Dictionary) -> dict:
    for left, right in o.get("inhibitedpair", []):
        d.inhibit(left, right)
    return {}


register("input text", "DefaultInputTextPlugin", _default_text)
register("input text", "ProlongedSoundMarkInputTextPlugin", lambda o, d: {"marks": tuple(o["prolongedsoundmarks"]), "mark_to": o["replacementsymbol"]})
register("unknown words", "MeCabOovProviderPlugin", _mecab)
register("unknown words", "SimpleOovProviderPlugin", lambda o, d: {"oov": ("simple",), "simple": (_known(d, o["oovpos"]), o["leftid"], o["rightid"], o["cost"])})
register("path rewriting", "JoinNumericPlugin", lambda o, d: {"rewrite": ("numeric",), "normalize_numeric": o.get("enablenormalize", True)})
register("path rewriting", "JoinKatakanaOovPlugin", lambda o, d: {"rewrite": ("katakana",), "katakana_pos": _known(d, o["oovpos"]), "min_length": o.get("minlength", 1)})
register("connection cost", "InhibitConnectionPlugin", _inhibit)


def options(s: definitions.Settings, d: Dictionary) -> dict:
    """Keyword arguments of a tokenizer from settings; a plugin that has no maker is an error."""
    out: dict = {"normalize": False, "marks": (), "oov": (), "rewrite": (), "texts": ()}
    text = _read(s.char_def)
    if text is not None:
        out["table"] = definitions.char_ranges(text)
    for kind, plugins in zip(KINDS, (s.text_plugins, s.oov_plugins, s.path_plugins, s.cost_plugins)):
        for p in plugins or []:
            name = p.get("name") or p.get("class") or ""
            maker = _MAKERS[kind].get(name) or _MAKERS[kind].get(name.rpartition(".")[2])
            if maker is None:
                raise ValueError(f"{kind}: {name} is unknown")
            for k, v in maker({k.lower(): v for k, v in p.items()}, d).items():
                out[k] = (*out[k], *v) if k in ("oov", "rewrite", "texts") else v
    return out


def tokenizer(s: definitions.Settings, d: Dictionary) -> Tokenizer:
    return Tokenizer(d, **options(s, d))


class FromFiles:
    """Makes a tokenizer in a worker from settings and the compiled dictionaries they name, or given ones; the files are
    read there, so nothing large travels with a task. Paths must be readable by all executors."""

    def __init__(self, settings: str, system: str | None = None, users: tuple[str, ...] = (), resource_dir: str | None = None, utf16: bool = False):
        self.args = (settings, system, tuple(users), resource_dir, utf16)

    def __hash__(self):
        return hash(self.args)

    def __eq__(self, other):
        return isinstance(other, FromFiles) and self.args == other.args

    def __call__(self) -> Tokenizer:
        from ..sources import binary, files

        settings, system, users, resource_dir, utf16 = self.args
        s = definitions.Settings.parse(settings, resource_dir)
        d = binary.load(files.read(system or s.system_dict), [files.read(u) for u in users or s.user_dict], utf16, lambda d, head: _auto(s, d, head))
        return tokenizer(s, d)


def _auto(s: definitions.Settings, d: Dictionary, head: str) -> int:
    from .tokenize import auto_cost

    how = options(s, d)
    how.pop("rewrite")
    return auto_cost(d, head, **how)
