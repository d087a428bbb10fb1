"""Frozen constants.

Every value in this module is a fixed value: it must equal the published
contract for results to agree, so it is stated plainly and never tuned here.
"""

from __future__ import annotations

# Normalised difference indices: name -> (positive band, negative band).
INDEX_BANDS = {
    "NDVI": ("nir", "red"),
    "NDWI": ("green", "nir"),
    "MNDWI": ("green", "swir"),
    "NDBI": ("swir", "nir"),
}
# Physical fallback cut per index and the class that lies above it.
INDEX_CUTS = {"NDVI": 0.3, "NDWI": 0.2, "MNDWI": 0.0, "NDBI": 0.0}
INDEX_TARGETS = {"NDVI": "vegetation", "NDWI": "water", "MNDWI": "water", "NDBI": "builtup"}

# Otsu gate.
OTSU_BINS = 256
OTSU_MIN_RATIO = 0.5
OTSU_MIN_CLASS = 0.05
OTSU_SLACK = 0.1
FALLBACK_MULTIPLIER = 0.75

# Radar: decibel floor, preferred polarisation order, stack pairs, water/built-up cuts.
DB_FLOOR = -50.0
POL_ORDER = ("vv", "hh", "vh", "hv")
SAR_CUTS_DB = {
    "vv": {"water": -18.0, "builtup": -3.0},
    "vh": {"water": -24.0, "builtup": -12.0},
    "hh": {"water": -18.0, "builtup": -3.0},
    "hv": {"water": -24.0, "builtup": -12.0},
}
SURFACE_RANGES_DB = {
    "calm_water": (-25.0, -20.0),
    "smooth_bare_soil": (-15.0, -12.0),
    "rough_soil_crops": (-12.0, -8.0),
    "forest": (-8.0, -6.0),
    "urban": (-5.0, 5.0),
}
SURFACE_MARGIN_DB = 10.0
INHERITED_BAND_PENALTY = 0.8
POL_DROPOUT_RATE = 0.25

# Radiometry.
STRETCH_PERCENTILES = (0.02, 0.98)
STRETCH_EPSILON = 1e-6
NODATA_WARN = 0.5
OVERVIEW_MAX_SIDE = 512

# Modality cascade.
SPECKLE_MIN = (0.9, 1.0)
AMBIGUOUS_MIN = (0.6, 0.6)
DB_NEGATIVE_MIN = 0.3
DB_RANGE = (-60.0, 30.0)
DB_MUST_REACH = -5.0
MIN_BAND_VALUES = 16

# Band inventory.
BAND_NAMES = ("blue", "green", "red", "nir", "swir", "vv", "vh", "hh", "hv")
S2_DESIGNATIONS = (
    ("b02", "blue"),
    ("b03", "green"),
    ("b04", "red"),
    ("b08", "nir"),
    ("b8a", "nir"),
    ("b11", "swir"),
    ("b12", "swir"),
)
ASSUMED_ORDERS = {3: ("blue", "green", "red"), 4: ("blue", "green", "red", "nir")}
ASSUMED_SAR_ORDERS = {2: ("vh", "vv")}

# Texture.
TEXTURE_WINDOW = 9
GLCM_LEVELS = 16
OPENING_RADIUS = 1
MIN_COMPONENT_FRACTION = 0.0005
MAX_PROPOSALS = 8
TEXTURE_CUT = 0.35
TEXTURE_DIGITS = 9
PROPOSAL_CEILING = 0.35
# noun -> (max aspect ratio, min solidity)
SHAPE_PRIORS = {
    "ship": (8.0, 0.35),
    "tank": (1.6, 0.6),
    "aircraft": (3.0, 0.25),
    "vehicle": (3.0, 0.4),
    "bridge": (20.0, 0.15),
    "runway": (30.0, 0.15),
    "harbour": (6.0, 0.2),
    "crane": (10.0, 0.2),
    "building": (4.0, 0.5),
    "builtup": (100.0, 0.1),
}
DEFAULT_PRIOR = (12.0, 0.15)

# Tiling.
TILE_OVERLAP = 0.10
TILE_SIDE = 512
MAX_TILES = 256
TOP_K_TILES = 4
MAX_TILE_PIXELS = 262144

# Registration.
COREG_MAX_PX = 1.0
COREG_REFUSE_PX = 8.0
MI_BINS = 32

# Fusion.
IOU_CONSISTENT = 0.6
IOU_CONFLICT = 0.3
DISAGREEMENT_PENALTY = 0.6
SINGLE_MODALITY_FACTOR = 0.9
SOIL_NDVI_MAX = 0.15
SOIL_BRIGHTNESS_PERCENTILE = 0.60
ARID_NDVI_MAX = 0.1

# Answer wording.
MAGNITUDE_BANDS = ((0, "none"), (10, "a few"), (50, "dozens"))
MAGNITUDE_TOP = "many"

# Sensor words looked for in the sensor tags; radar is tried first.
SENSOR_TAG_KEYS = ("SENSOR", "SATELLITE", "PLATFORM", "SPACECRAFT", "INSTRUMENT", "MISSION")
SAR_SENSOR_TOKENS = (
    "SENTINEL-1", "SENTINEL1", "S1", "RISAT", "EOS-04", "CAPELLA", "UMBRA", "TERRASAR",
    "TANDEM-X", "TSX", "ALOS-2", "PALSAR", "ICEYE", "SAR",
)
OPTICAL_SENSOR_TOKENS = (
    "SENTINEL-2", "SENTINEL2", "S2", "CARTOSAT", "LANDSAT", "PLEIADES", "WORLDVIEW",
    "QUICKBIRD", "NAIP", "SPOT-6", "SPOT-7", "RAPIDEYE", "RESOURCESAT",
)

# Published per-band mean and standard deviation.
S1_STATS = {
    "VV": (-12.619993741972035, 5.115911777546365),
    "VH": (-19.29044597721542, 5.464428464912864),
}
S2_STATS = {
    "B02": (429.9430203, 572.41639287),
    "B03": (614.21682446, 582.87945694),
    "B04": (590.23569706, 675.88746967),
    "B05": (950.68368468, 729.89827633),
    "B06": (1792.46290469, 1096.01480586),
    "B07": (2075.46795189, 1273.45393088),
    "B08": (2218.94553375, 1365.45589904),
    "B8A": (2266.46036911, 1356.13789355),
    "B11": (1594.42694882, 1079.19066363),
    "B12": (1009.32729131, 818.86747235),
}

# Composite -> bands in (red, green, blue) slot order.
COMPOSITES = {
    "true_colour": ("B04", "B03", "B02"),
    "false_colour": ("B08", "B04", "B03"),
    "short_wave": ("B12", "B11", "B08"),
}

# Patch grid: 10 980 px granule cut into 120 px patches.
PATCHES_PER_AXIS = 91
PATCH_SIDE_PX = 120
PATCH_ID_PATTERN = (
    r"^(S2[AB])_(MSIL[12][ABC])_(\d{8}T\d{6})_(N\d{4})_(R\d{3})_(T\d{2}[A-Z]{3})_(\d{1,3})_(\d{1,3})$"
)
GRID_CONVENTIONS = (
    "col_row_from_northwest", "row_col_from_northwest", "col_row_from_southwest", "row_col_from_southwest",
)

# Mask and cloud gates.
MASK_STRIDE = 4
MAX_MASKED_SHARE = 0.01
MAX_NODATA_SHARE = 0.2
MAX_CLOUD_SHARE = 0.05
CLOUD_CLASSES = (1, 3, 8, 9, 10)

# What a raster of each modality must hold.
RASTER_EXPECTATIONS = {
    "S1": {"min_bands": 2, "dtypes": ("float32", "float64"), "negative": True},
    "S2": {"min_bands": 10, "dtypes": ("uint16", "int16"), "negative": False},
}

# Change questions over persistent objects.
EXACT_COUNT_MAX = 20
CLUSTER_MIN_POINTS = 6
CLUSTER_MIN_SHARE = 0.65
DEFAULT_ANSWER_CAP = 400
DEFAULT_TASK_CAP = 2500

# Land-cover vocabulary, alphabetical as the classifiers emit it.
LANDCOVER_CLASSES = (
    "Agro-forestry areas",
    "Arable land",
    "Beaches, dunes, sands",
    "Broad-leaved forest",
    "Coastal wetlands",
    "Complex cultivation patterns",
    "Coniferous forest",
    "Industrial or commercial units",
    "Inland waters",
    "Inland wetlands",
    "Land principally occupied by agriculture, with significant areas of natural vegetation",
    "Marine waters",
    "Mixed forest",
    "Moors, heathland and sclerophyllous vegetation",
    "Natural grassland and sparsely vegetated areas",
    "Pastures",
    "Permanent crops",
    "Transitional woodland, shrub",
    "Urban fabric",
)
FOREST_CLASSES = ("Broad-leaved forest", "Coniferous forest", "Mixed forest")
LANDCOVER_THRESHOLD = 0.5
SWEEP_THRESHOLDS = (0.2, 0.3, 0.4, 0.5, 0.6, 0.7)

# Physical causes of an optical / radar disagreement: cause -> winning sensor.
DISAGREEMENT_WINNERS = {
    "cloud_over_water": "sar",
    "wet_smooth_soil": "optical",
    "radar_shadow": "optical",
    "wind_roughened_surface": "optical",
    "dry_smooth_sand": "optical",
}
