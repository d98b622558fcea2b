"""Fixed values and row shapes shared by the operators."""

from __future__ import annotations

from pyspark.sql import types as T

# --- Fixed values: endings, limits, keys and texts that results must show exactly so ---

# File name endings that make a file an image; ".tif" is not among them.
IMAGE_SUFFIXES = [".jpg", ".jpeg", ".png", ".gif", ".bmp", ".webp", ".tiff"]
ANIMATED_EXTENSIONS = ["webp", "gif"]

MAX_FILE_BYTES = 75 * 1024 * 1024
MAX_PIXELS = 100 * 1024 * 1024
DEFAULT_PAGE_SIZE = 200
MAX_PAGE_SIZE = 5000
COVER_COUNT = 3

CORE_KEYS = ["Seed", "Steps", "CFG", "Sampler", "Scheduler", "AspectRatio"]
# Key -> label, in display order.
SECONDARY_LABELS = {
    "clip_skip": "Clip Skip",
    "hires_upscale": "Hires Upscale",
    "hires_steps": "Hires Steps",
    "denoising_strength": "Denoising",
    "vae": "VAE",
    "model_hash": "Model Hash",
    "ensd": "ENSD",
    "aesthetic_score": "Aesthetic",
}
OTHER_KNOWN_KEYS = ["Model", "Lora", "Width", "Height", "SwarmVersion"]

# error_type, title, suggestion, can_retry
ERRORS = [
    ("not_found", "Folder not found", "The folder may have been moved or deleted.", False),
    ("not_directory", "Not a folder", "The selected path is not a valid folder.", False),
    ("permission", "Access denied", "You don't have permission to access this folder.", False),
    ("invalid_file", "Invalid file", "This file type is not supported.", False),
    ("timeout", "Taking too long", "The folder has too many files. Try a smaller folder.", True),
    ("server_error", "Something went wrong", "An unexpected error occurred. Please try again.", True),
    ("network", "Can't connect to server", "Check if the backend is running and try again.", True),
]
DEFAULT_ERROR = "server_error"

TOOL_SWARM = "SwarmUI"
TOOL_COMFY = "ComfyUI"
TOOL_NOVELAI = "NovelAI"
TOOL_A1111 = "A1111"
TOOL_EASY = "EasyDiffusion"
TOOL_UNKNOWN = "Unknown"
NOVELAI_PROMPT_PREFIX = "masterpiece, best quality,"

# --- Row shapes --------------------------------------------------------------

INVENTORY = T.StructType([
    T.StructField("file_id", T.LongType()),
    T.StructField("folder", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("mtime", T.TimestampNTZType()),
    T.StructField("length", T.LongType()),
    T.StructField("width", T.IntegerType()),
    T.StructField("height", T.IntegerType()),
])

RAW_TAGS = T.StructType([
    T.StructField("file_id", T.LongType()),
    T.StructField("parameters", T.StringType()),
    T.StructField("prompt_json", T.StringType()),
    T.StructField("workflow_json", T.StringType()),
    T.StructField("user_comment", T.StringType()),
    T.StructField("sidecar_text", T.StringType()),
])

MODEL_TYPE = "struct<name:string,param:string,hash:string>"
# What every parser yields; NULL when the parser declines the row.
RECORD_TYPE = (
    "struct<tool:string,prompt:string,negative_prompt:string,params:map<string,string>,"
    f"loras:array<string>,models:array<{MODEL_TYPE}>,date:string,generation_time:string>"
)
METADATA_COLUMNS = [
    "file_id", "tool", "prompt", "negative_prompt", "params", "loras", "models", "date",
    "generation_time", "width", "height", "name", "error_type", "error_message",
]
