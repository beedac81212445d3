"""penumbra: soft (membership-based) clustering and data processing on Spark DataFrames.

All 42 estimators are names of this package, loaded when first used: `from penumbra import FCM`.
"""

from __future__ import annotations

from importlib import import_module

__version__ = "0.1.0"

_WHERE = {
    "prototypes": "FCM PCM PFCM CAFCM CAFHFCM AFCMSimple ENTROPYFCM ECM FCC KFCM RoughKMeans RPFKM SFCMEP",
    "mixtures": "GK GathGeva GMM MBMM BGMM",
    "pairwise": "SCM SoftDBSCANGM KFCCL AFCM EVCLUS SoftKSC",
    "images": "AFCMAdaptive SKFCM",
    "consensus": "SCSPA SHBGF SMCLA",
    "graphs": "BIGCLAM BayesianNMF MMSB CDCGS DMoN NOCD",
    "documents": "LDA PLSI KMART SISC WBSC",
    "federated": "FeMIFuzzy",
    "autoencoder": "RDFKC",
}
_MODULE = {name: module for module, names in _WHERE.items() for name in names.split()}
__all__ = sorted(_MODULE)


def __getattr__(name: str):
    if name not in _MODULE:
        raise AttributeError(f"module {__name__} has no attribute {name}")
    cls = getattr(import_module(f"penumbra.operators.{_MODULE[name]}"), name)
    globals()[name] = cls
    return cls


def __dir__() -> list[str]:
    return sorted({*globals(), *__all__})
