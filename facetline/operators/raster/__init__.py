"""Raster kernels: numpy functions on one image's arrays, which tasks apply to batches of rows.

Rasters are (h, w, 4) uint8 with straight alpha; masks are (h, w) bool; coordinates are x to the right, y down.
"""
