"""Named chains of spectral corrections and their assembly with outlier detection."""

from __future__ import annotations

from pyspark.ml import Pipeline

from wavetable.operators.outliers import OutlierDetector
from wavetable.operators.transform import MSC, SNV, ChannelPCA, ChannelScaler, SavGol


# Chain names, their window of 15, order of 2 and ten components.
def chains(spectrum: str = "spectrum") -> dict[str, list]:
    """Stages by chain name."""
    on = {"spectrumCol": spectrum}

    def derivative(order):
        return SavGol(window=15, polyorder=2, deriv=order, **on)

    return {
        "raw": [ChannelScaler(**on)],
        "snv": [SNV(**on)],
        "sg1": [derivative(1)],
        "sg2": [derivative(2)],
        "msc": [MSC(**on)],
        "snv_pca": [SNV(**on), ChannelPCA(nComponents=10, **on)],
        "sg1_pca": [derivative(1), ChannelPCA(nComponents=10, **on)],
    }


def build_chain(
    method: str = "raw",
    outliers: bool = True,
    outlier_method: str = "zscore",
    threshold: float = 3.0,
    remove_outliers: bool = False,
    custom=(),
    spectrum: str = "spectrum",
) -> Pipeline:
    """[outlier detector] + named chain + custom stages. The flag is a column of its own."""
    known = chains(spectrum)
    if method not in known:
        raise ValueError(f"unknown preprocessing method: {method}; use one of {', '.join(known)}")
    stages = list(known[method])
    if outliers:
        detector = OutlierDetector(
            method=outlier_method, threshold=threshold, removeOutliers=remove_outliers, spectrumCol=spectrum
        )
        stages.insert(0, detector)
    return Pipeline(stages=[*stages, *custom])


def correction_stages(transform: str = "snv", savgol: bool = False, window=15, polyorder=2, deriv=0, spectrum="spectrum"):
    """SNV or MSC first, then Savitzky-Golay."""
    on = {"spectrumCol": spectrum}
    stages = {"none": [], "snv": [SNV(**on)], "msc": [MSC(**on)]}
    if transform not in stages:
        raise ValueError(f"unknown transformation method: {transform}")
    tail = [SavGol(window=window, polyorder=polyorder, deriv=deriv, **on)] if savgol else []
    return stages[transform] + tail
