"""Raster analytics on Spark DataFrames: filters, sliding windows, gradients, features, denoising."""

from rastrum.functions.borders import NA, Fill, Inner, Pad, border
from rastrum.functions.kernels import Kernel, OneD, centered, convolve_kernels, factored, iir_gaussian, reflect
from rastrum.operators.denoise import denoise_tv
from rastrum.operators.features import blob_log, find_local_maxima, find_local_minima, gradients
from rastrum.operators.filtering import filter_raster
from rastrum.operators.padding import pad_raster
from rastrum.operators.windows import map_window
from rastrum.raster import Axis, Raster

__all__ = [
    "NA", "Axis", "Fill", "Inner", "Kernel", "OneD", "Pad", "Raster", "blob_log", "border", "centered", "convolve_kernels",
    "denoise_tv", "factored", "filter_raster", "find_local_maxima", "find_local_minima", "gradients", "iir_gaussian", "map_window", "pad_raster", "reflect",
]
