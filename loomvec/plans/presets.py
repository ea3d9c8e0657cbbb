"""Named settings of compressors and caches."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import expr as E
from ..operators import allocation as B
from ..operators import normalize as N
from ..operators.compressors import KeyCompressor, Mse, ValueCompressor, tower_transform


@dataclass(frozen=True)
class Preset:
    rotation: str = "wht"
    quantizer: str = "scalar"
    bits: int = 3
    use_qjl: bool = True
    use_sign_packing: bool = True
    adaptive: bool = False
    hierarchical: bool = False
    min_level_bits: int = 2
    max_level_bits: int = 5

    def keys(self, d: int, seed: int = 42) -> KeyCompressor:
        """Keys with a sketch of the residual if the preset has one. `adaptive` and `hierarchical` are what restored() does; use_sign_packing is how many bytes a sign takes (sign_bytes)."""
        return KeyCompressor(d, self.bits, self.rotation, self.quantizer, seed, use_qjl=self.use_qjl)

    def sign_bytes(self, d: int) -> int:
        """Bytes of a key's signs: none without a sketch, packed or one byte a sign."""
        return 0 if not self.use_qjl else E.packed_bytes(d) if self.use_sign_packing else E.unpacked_bytes(d)

    def restored(self, df: DataFrame, d: int, column: str = "vec", out: str = "restored", seed: int = 42) -> DataFrame:
        """df with vectors through the preset's quantizer and back: by levels of a tower where it is hierarchical, scaled to the vector afterwards where it is adaptive."""
        if self.hierarchical:
            bits = B.tower_bits(d, self.bits * d, self.min_level_bits, self.max_level_bits)
            t = tower_transform(df, bits, column, out, seed)
        else:
            t = Mse(d, self.bits, self.rotation, self.quantizer, seed).fit(df, column).transform(df, column, out)
        return t.withColumn(out, N.adaptive_scale(F.col(column), F.col(out))) if self.adaptive else t

    def values(self, d: int, seed: int = 142) -> ValueCompressor:
        return ValueCompressor(d, self.bits, self.rotation, self.quantizer, seed)


def _power(d: int) -> bool:
    return d & (d - 1) == 0


def recommended(d: int = 128, bits: int = 4) -> Preset:
    return Preset("wht" if d >= 64 and _power(d) else "haar", bits=bits, use_qjl=bits <= 3)


def recommended_e8(d: int = 128) -> Preset:
    return Preset("cd8", "e8")


def published_default(bits: int = 3) -> Preset:
    return Preset("haar", bits=bits, use_sign_packing=False)


def fast(d: int = 128, bits: int = 3) -> Preset:
    return Preset("wht" if _power(d) else "haar", bits=bits, use_qjl=bits <= 2)


def experimental_tower(d: int = 128, bits: int = 3) -> Preset:
    return Preset(bits=bits, use_qjl=bits <= 3, adaptive=True, hierarchical=True, min_level_bits=1)


def experimental_clifford(d: int = 128, bits: int = 3) -> Preset:
    return Preset("clifford", bits=bits, use_qjl=bits <= 3)


@dataclass(frozen=True)
class CachePreset:
    """Keys and values apart: keys need inner products, values need small errors."""

    keys: Preset = field(default_factory=Preset)
    values: Preset = field(default_factory=lambda: replace(Preset(), use_qjl=False))
    key_axis: str = "per_channel"
    value_axis: str = "per_token"
    group_size: int = 128
    sink: int = 4
    recent: int = 128


def per_axis(key_bits: int = 2, value_bits: int = 2) -> CachePreset:
    return CachePreset(Preset(bits=key_bits), Preset(bits=value_bits, use_qjl=False))


def enhanced(key_bits: int = 3, value_bits: int = 3) -> CachePreset:
    return CachePreset(Preset(bits=key_bits, use_qjl=key_bits <= 3), Preset(bits=value_bits, use_qjl=False))
