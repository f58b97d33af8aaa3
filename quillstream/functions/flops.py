"""Work of forward passes, in exact integer arithmetic (decimals: it exceeds 2^53)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

BIG = "decimal(38,0)"


@dataclass(frozen=True)
class Model:
    """Per token of the linear layers, per query-key pair and layer of attention, per position of
    the head; layers of full and of sliding attention, with the window of the latter."""

    linear: int
    pair: int
    head: int
    full_layers: int
    sliding_layers: int = 0
    window: int = 0

    @classmethod
    def of(
        cls, layers: int, hidden: int, heads: int, kv_heads: int, head_dim: int, intermediate: int, vocabulary: int, sliding_layers: int = 0,
        window: int = 0
    ) -> "Model":
        """Two operations for each weight used: projections and a gated feed-forward block."""
        weights = hidden * head_dim * (heads + 2 * kv_heads) + heads * head_dim * hidden + 3 * hidden * intermediate
        return cls(2 * layers * weights, 4 * heads * head_dim, 2 * hidden * vocabulary, layers - sliding_layers, sliding_layers, window)


def model_of(config: dict) -> Model:
    """From a published configuration: names of dense and mixture models, a nested text part,
    defaults for key-value heads and the head's width; experts count as often as a token uses them."""
    raw = {**config, **config["text_config"]} if "hidden_size" not in config and isinstance(config.get("text_config"), dict) else dict(config)

    def need(name: str) -> int:
        value = raw.get(name)
        if isinstance(value, bool) or not isinstance(value, int) or value <= 0:
            raise ValueError(f"{name} must be a positive integer, not {value!r}")
        return value

    hidden, layers, heads = need("hidden_size"), need("num_hidden_layers"), need("num_attention_heads")
    if raw.get("head_dim") is None and hidden % heads:
        raise ValueError("head_dim is not given and heads do not divide hidden_size")
    width = raw.get("head_dim") or hidden // heads
    experts = raw.get("num_experts") or raw.get("num_local_experts") or 0
    used = raw.get("num_experts_per_tok") or raw.get("experts_per_token") or 0
    if experts and not 0 < used <= experts:
        raise ValueError("experts used by a token must be from 1 to all")
    size = (raw.get("moe_intermediate_size") or need("intermediate_size")) * used if experts else need("intermediate_size")
    kinds = raw.get("layer_types") or []
    sliding = sum(k == "sliding_attention" for k in kinds)
    return Model.of(
        layers, hidden, heads, raw.get("num_key_value_heads") or heads, width, size, need("vocab_size"), sliding,
        (raw.get("sliding_window") or 0) if sliding else 0
    )


def big(x: Column) -> Column:
    return x.cast(BIG)


def triangle(n: Column) -> Column:
    """Query-key pairs of causal attention over n positions."""
    return (big(n) * (n + 1) / 2).cast(BIG)


def window_pairs(n: Column, window: int) -> Column:
    """Sum of min(position, window) over n positions."""
    c = F.least(n, F.lit(window))
    return (triangle(c) + big(n - c) * window).cast(BIG)


def attention(m: Model, start: Column, end: Column) -> Column:
    """Between a cached prefix and a final length: differences of pairs."""
    out = (triangle(end) - triangle(start)) * m.full_layers
    if m.sliding_layers:
        out = out + (window_pairs(end, m.window) - window_pairs(start, m.window)) * m.sliding_layers
    return (out * m.pair).cast(BIG)


def perplexity_flops(m: Model, length: Column) -> Column:
    """One pass over a sequence, the head at each position."""
    return (big(length) * (m.linear + m.head) + attention(m, F.lit(0).cast("long"), length)).cast(BIG)


def generation_flops(m: Model, prompt: Column, completion: Column, cached: Column) -> Column:
    """Prefill of what is not cached, which gives the first token, then one pass for each other
    token; the head for each completion token."""
    decode = F.greatest(completion - 1, F.lit(0))
    end = prompt + decode
    bad = F.raise_error(F.lit("more cached than prompt tokens")).cast(BIG)
    total = big(end - cached) * m.linear + attention(m, cached, end) + big(completion) * m.head
    return F.when(cached > prompt, bad).otherwise(total.cast(BIG))
