"""Settings of the embedding providers, from stored keys, the environment and defaults. All of it is the driver's."""

from __future__ import annotations

import json
import os
from collections.abc import Mapping
from dataclasses import dataclass, field

PREFIX = "semantic."
# Provider names, and keys with their defaults.
PROVIDERS = {"openai": "openai", "onnx": "onnx", "local": "onnx", "gemma": "gemma"}
DEFAULTS = {
    "openai.model": "text-embedding-3-small",
    "openai.maxTokens": 8000,
    "onnx.modelName": "bge-small-en-v1.5",
    "onnx.embeddingDim": 384,
    "onnx.maxLength": 512,
    "gemma.embeddingDim": 768,
}


def provider_name(text: str) -> str:
    try:
        return PROVIDERS[text.lower()]
    except KeyError:
        raise ValueError(f"Unknown provider: {text}. Valid options: openai, onnx, gemma") from None


class Settings:
    """Keys and values in a JSON file, or only in memory without one."""

    def __init__(self, path: str | None = None) -> None:
        self.path, self.values = path, {}
        if path and os.path.exists(path):
            with open(path, encoding="utf-8") as f:
                self.values = json.load(f)

    def get(self, key: str) -> str | None:
        return self.values.get(PREFIX + key)

    def set(self, key: str, value: str) -> None:
        self.values[PREFIX + key] = value
        self._save()

    def unset(self, key: str) -> None:
        if self.values.pop(PREFIX + key, None) is None:
            raise KeyError(f"Failed to unset {PREFIX}{key}")
        self._save()

    def _save(self) -> None:
        if self.path:
            with open(self.path, "w", encoding="utf-8") as f:
                json.dump(self.values, f, indent=1, sort_keys=True)


@dataclass
class EmbeddingConfig:
    provider: str = "onnx"
    options: dict = field(default_factory=lambda: dict(DEFAULTS))
    api_key: str | None = None

    @property
    def dimension(self) -> int | None:
        """What the provider's vectors have; unknown for remote models, whose vectors tell."""
        return self.options.get(f"{self.provider}.embeddingDim")


def load(settings: Settings, environment: Mapping[str, str] | None = None) -> EmbeddingConfig:
    """A stored key, else SEMANTIC_PROVIDER, else onnx; numbers that cannot be read are defaults; an unknown provider is an error."""
    env = os.environ if environment is None else environment
    name = provider_name(settings.get("provider") or env.get("SEMANTIC_PROVIDER") or "onnx")
    options = {}
    for key, default in DEFAULTS.items():
        value = settings.get(key)
        options[key] = default if value is None or (isinstance(default, int) and not value.isdigit()) else type(default)(value)
    options |= {k: v for k in ("onnx.modelPath", "onnx.tokenizerPath") if (v := settings.get(k))}
    return EmbeddingConfig(name, options, env.get("OPENAI_API_KEY"))


def load_or_default(settings: Settings, environment: Mapping[str, str] | None = None) -> EmbeddingConfig:
    try:
        return load(settings, environment)
    except ValueError:
        return EmbeddingConfig()


def save(config: EmbeddingConfig, settings: Settings) -> None:
    settings.set("provider", config.provider)
    for key, value in config.options.items():
        settings.set(key, str(value))


def shown(config: EmbeddingConfig) -> list[str]:
    out = ["[semantic]", f"  provider = {config.provider}"]
    for section in ("openai", "onnx", "gemma"):
        out += ["", f"[semantic.{section}]"] + [f"  {k.split('.')[1]} = {v}" for k, v in config.options.items() if k.startswith(f"{section}.")]
        if section == "openai" and config.api_key:
            out.append("  apiKey = ***set via OPENAI_API_KEY***")
    return out


def command(settings: Settings, key: str | None = None, value: str | None = None, list_: bool = False, get: bool = False, unset: bool = False, environment: Mapping[str, str] | None = None) -> list[str]:
    """Lines that the configuration command prints; list goes before unset, get, set, a bare key, and showing all."""
    if list_ or (key is None and not get and not unset):
        return shown(load(settings, environment))
    if key is None:
        raise ValueError("Key required")
    if unset:
        settings.unset(key)
        return [f"Unset {PREFIX}{key}"]
    if get or value is None:
        if (found := settings.get(key)) is None:
            raise KeyError(f"Configuration key '{PREFIX}{key}' not found")
        return [found]
    settings.set(key, value)
    return [f"Set {PREFIX}{key} = {value}"]
