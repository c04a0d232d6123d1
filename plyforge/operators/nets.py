"""Forward passes of two value networks in numpy, from exported weights: scorers for ``search``.

Weights are a mapping of names to arrays, as ``numpy.savez`` keeps them; names and shapes are those of the usual
export of such nets (a residual tower with batch norms; a pre-norm encoder over one token per square). Input is
(n, 18, 8, 8), output (n,) in [-1, 1] from the side to move's view.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass
from dataclasses import fields as dataclass_fields

import numpy as np

from plyforge.functions import rules

Weights = Mapping[str, np.ndarray]


class UnknownArchitectureError(ValueError):
    """Weights of no network known here."""


@dataclass(frozen=True)
class ResNetConfig:
    channels: int = 128
    blocks: int = 8
    value_channels: int = 32
    value_hidden: int = 256
    planes: int = 18

    def shapes(self) -> dict[str, tuple[int, ...]]:
        """Names and shapes of the trainable weights."""
        c, v = self.channels, self.value_channels
        norm = lambda at, n: {f"{at}.weight": (n,), f"{at}.bias": (n,)}
        out = {"stem.0.weight": (c, self.planes, 3, 3)} | norm("stem.1", c)
        for b in range(self.blocks):
            for k in (1, 2):
                out |= {f"blocks.{b}.conv{k}.weight": (c, c, 3, 3)} | norm(f"blocks.{b}.norm{k}", c)
        out |= {"value_head.conv.weight": (v, c, 1, 1)} | norm("value_head.norm", v)
        out |= {"value_head.fc1.weight": (self.value_hidden, v * 64), "value_head.fc1.bias": (self.value_hidden,)}
        return out | {"value_head.fc2.weight": (1, self.value_hidden), "value_head.fc2.bias": (1,)}


@dataclass(frozen=True)
class TransformerConfig:
    d_model: int = 192
    layers: int = 6
    heads: int = 8
    feedforward: int = 768
    value_hidden: int = 256
    planes: int = 18
    pooling: str = "cls"

    def __post_init__(self) -> None:
        if self.d_model % self.heads:
            raise ValueError(f"{self.d_model} features do not divide among {self.heads} heads")
        if self.pooling not in ("cls", "mean"):
            raise ValueError(f"unknown pooling {self.pooling!r}")

    def shapes(self) -> dict[str, tuple[int, ...]]:
        """Names and shapes of the trainable weights."""
        d, f = self.d_model, self.feedforward
        out = {"input_projection.weight": (d, self.planes), "input_projection.bias": (d,), "positions": (1, 64, d)}
        if self.pooling == "cls":
            out["cls_token"] = (1, 1, d)
        for n in range(self.layers):
            at = f"encoder.layers.{n}."
            out |= {at + "self_attn.in_proj_weight": (3 * d, d), at + "self_attn.in_proj_bias": (3 * d,), at + "self_attn.out_proj.weight": (d, d), at + "self_attn.out_proj.bias": (d,)}
            out |= {at + "linear1.weight": (f, d), at + "linear1.bias": (f,), at + "linear2.weight": (d, f), at + "linear2.bias": (d,)}
            out |= {at + f"norm{k}.{w}": (d,) for k in (1, 2) for w in ("weight", "bias")}
        out |= {"norm.weight": (d,), "norm.bias": (d,), "value_head.fc1.weight": (self.value_hidden, d), "value_head.fc1.bias": (self.value_hidden,)}
        return out | {"value_head.fc2.weight": (1, self.value_hidden), "value_head.fc2.bias": (1,)}


def describe_config(config: ResNetConfig | TransformerConfig) -> str:
    """A net's settings and size in a line."""
    if isinstance(config, ResNetConfig):
        shape = f"residual tower, {config.blocks} blocks of {config.channels} channels"
    else:
        shape = f"encoder over squares, {config.layers} layers of {config.d_model} features, {config.heads} heads, {config.pooling} pooling"
    return f"{shape}, value head of {config.value_hidden}, {count_parameters(config):,} parameters"


def config_from(fields: Mapping[str, object]) -> ResNetConfig | TransformerConfig:
    """The settings a mapping of field names stands for, as kept beside exported weights; others are errors."""
    for kind in (ResNetConfig, TransformerConfig):
        if fields and set(fields) <= {f.name for f in dataclass_fields(kind)} and set(fields) & ({"channels", "blocks"} if kind is ResNetConfig else {"d_model", "layers"}):
            return kind(**fields)
    raise UnknownArchitectureError(sorted(fields))


def count_parameters(config: ResNetConfig | TransformerConfig) -> int:
    return sum(int(np.prod(s)) for s in config.shapes().values())


def random_weights(config: ResNetConfig | TransformerConfig, seed: int = 0) -> dict[str, np.ndarray]:
    """Small random weights of the right shapes, norms at their neutral values."""
    coin = np.random.default_rng(seed)
    out = {}
    for name, shape in config.shapes().items():
        if "norm" in name or re.match(r"stem\.1", name):
            out[name] = np.ones(shape) if name.endswith("weight") else np.zeros(shape)
        else:
            out[name] = coin.normal(0, 0.05, shape)
    return out


def _linear(w: Weights, at: str, x: np.ndarray) -> np.ndarray:
    return x @ w[f"{at}.weight"].T + w[f"{at}.bias"]


def _conv(kernel: np.ndarray, x: np.ndarray) -> np.ndarray:
    """3 x 3 with a border of zeros, or 1 x 1, without bias."""
    size = kernel.shape[2]
    if size == 1:
        return np.einsum("oi,nixy->noxy", kernel[:, :, 0, 0], x, optimize=True)
    padded = np.pad(x, ((0, 0), (0, 0), (1, 1), (1, 1)))
    windows = np.lib.stride_tricks.sliding_window_view(padded, (3, 3), axis=(2, 3))
    return np.einsum("oiab,nixyab->noxy", kernel, windows, optimize=True)


def _batch_norm(w: Weights, at: str, x: np.ndarray) -> np.ndarray:
    n = x.shape[1]
    mean, var = w.get(f"{at}.running_mean", np.zeros(n)), w.get(f"{at}.running_var", np.ones(n))
    scale = w[f"{at}.weight"] / np.sqrt(var + 1e-5)
    return x * scale[None, :, None, None] + (w[f"{at}.bias"] - mean * scale)[None, :, None, None]


def _layer_norm(w: Weights, at: str, x: np.ndarray) -> np.ndarray:
    centred = x - x.mean(-1, keepdims=True)
    return centred / np.sqrt((centred**2).mean(-1, keepdims=True) + 1e-5) * w[f"{at}.weight"] + w[f"{at}.bias"]


def _gelu(x: np.ndarray) -> np.ndarray:
    """With the error function by a rational approximation, exact to 2e-7."""
    z = np.abs(x) / np.sqrt(2)
    t = 1 / (1 + 0.3275911 * z)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return x * 0.5 * (1 + np.sign(x) * (1 - poly * np.exp(-z * z)))


def resnet(w: Weights, planes: np.ndarray) -> np.ndarray:
    relu = lambda x: np.maximum(x, 0)
    x = relu(_batch_norm(w, "stem.1", _conv(w["stem.0.weight"], planes)))
    for b in range(len({k.split(".")[1] for k in w if k.startswith("blocks.")})):
        y = relu(_batch_norm(w, f"blocks.{b}.norm1", _conv(w[f"blocks.{b}.conv1.weight"], x)))
        x = relu(_batch_norm(w, f"blocks.{b}.norm2", _conv(w[f"blocks.{b}.conv2.weight"], y)) + x)
    head = relu(_batch_norm(w, "value_head.norm", _conv(w["value_head.conv.weight"], x))).reshape(len(planes), -1)
    return np.tanh(_linear(w, "value_head.fc2", relu(_linear(w, "value_head.fc1", head))))[:, 0]


def transformer(w: Weights, planes: np.ndarray, heads: int = 8) -> np.ndarray:
    n = len(planes)
    x = _linear(w, "input_projection", planes.reshape(n, planes.shape[1], 64).transpose(0, 2, 1)) + w["positions"]
    if "cls_token" in w:
        x = np.concatenate([np.broadcast_to(w["cls_token"], (n, 1, x.shape[2])), x], axis=1)
    length, d = x.shape[1:]
    for layer in range(len({k.split(".")[2] for k in w if k.startswith("encoder.layers.")})):
        at = f"encoder.layers.{layer}"
        y = _layer_norm(w, f"{at}.norm1", x) @ w[f"{at}.self_attn.in_proj_weight"].T + w[f"{at}.self_attn.in_proj_bias"]
        q, k, v = (y[..., i * d : (i + 1) * d].reshape(n, length, heads, d // heads).transpose(0, 2, 1, 3) for i in range(3))
        score = q @ k.transpose(0, 1, 3, 2) / np.sqrt(d // heads)
        score = np.exp(score - score.max(-1, keepdims=True))
        mixed = (score / score.sum(-1, keepdims=True)) @ v
        x = x + _linear(w, f"{at}.self_attn.out_proj", mixed.transpose(0, 2, 1, 3).reshape(n, length, d))
        x = x + _linear(w, f"{at}.linear2", _gelu(_linear(w, f"{at}.linear1", _layer_norm(w, f"{at}.norm2", x))))
    x = _layer_norm(w, "norm", x)
    pooled = x[:, 0] if "cls_token" in w else x.mean(1)
    return np.tanh(_linear(w, "value_head.fc2", _gelu(_linear(w, "value_head.fc1", pooled))))[:, 0]


class NetScorer:
    """A scorer of texts of positions from weights, in batches; broadcast it by closing over it."""

    def __init__(self, weights: Weights, batch_size: int = 512, heads: int = 8):
        self.weights, self.batch_size, self.heads = dict(weights), batch_size, heads
        if "stem.0.weight" in self.weights:
            self.forward = resnet
        elif "input_projection.weight" in self.weights:
            self.forward = lambda w, x: transformer(w, x, heads)
        else:
            raise UnknownArchitectureError(sorted(self.weights)[:5])

    @classmethod
    def load(cls, path: str, **options) -> NetScorer:
        with np.load(path) as data:
            return cls({k: data[k] for k in data.files}, **options)

    def __call__(self, fens: list[str]) -> np.ndarray:
        out = []
        for start in range(0, len(fens), self.batch_size):
            planes = np.stack([rules.planes(f) for f in fens[start : start + self.batch_size]]).astype(np.float64)
            planes[:, 17] /= 100
            out.append(self.forward(self.weights, planes))
        return np.concatenate(out) if out else np.zeros(0)

    def describe(self) -> str:
        kind = "residual tower" if "stem.0.weight" in self.weights else "encoder over squares"
        trainable = sum(int(np.prod(v.shape)) for k, v in self.weights.items() if "running_" not in k and "num_batches" not in k)
        return f"{kind}, {trainable:,} parameters, batches of {self.batch_size}"
