"""Fixed values of the evaluation protocol.

These must equal the published protocol for results to agree; everything else
in the library takes them as parameters.
"""

# Spatial grid (voxels, millimetres).
SPACING_MM = (1.25, 1.25, 2.0)
CROP_SHAPE = (240, 192, 128)
CANVAS_SHAPE = (96, 96, 160)
CANVAS_PADDING = 4
PATCH_SHAPE = (128, 128, 64)
VOXEL_VOLUME_MM3 = 3.125

# Intensities.
HU_LOW, HU_HIGH = -200.0, 300.0
HU_CENTER, HU_HALF_WIDTH = 50.0, 250.0
PROBABILITY_LEVELS = 65535

# Label codes.
LESION, ORGAN = 1, 4
LABEL_CODES = (0, 1, 2, 3, 4, 5, 6)

# Candidate generation and matching.
GATE_PROBABILITY = 0.10
GATE_MARGIN_MM = 20.0
SMOOTHING_SIGMA_MM = 2.5
PEAK_RADIUS_MM = 10.0
MINIMUM_SCORE = 0.01
MAXIMUM_CANDIDATES = 256
TOLERANCE_MM = 5.0

# Operating points and selection.
FP_TARGETS = (0.25, 0.5, 1.0, 2.0, 4.0, 8.0)
STANDARD_FP_TARGETS = (0.25, 0.5, 1.0, 2.0, 4.0)
DEPLOYMENT_FP_TARGET = 1.0
LESION_WEIGHT, ORGAN_WEIGHT = 0.70, 0.30
IMPROVEMENT_MARGIN = 1e-6
SIZE_BINS_MM = (20.0, 40.0)
SIZE_GROUPS = ("small_<=20mm", "medium_>20-40mm", "large_>40mm")

# Sampling.
SEED = 20260728
BOOTSTRAP_REPLICATES = 2000
MASK_RATIO = 0.45
MASK_BLOCK = (16, 16, 8)

# Words read as true.
TRUE_WORDS = ("true", "1", "yes")
TRUE_STATUS_WORDS = ("true", "1", "yes", "pass", "complete", "completed")
