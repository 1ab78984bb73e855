"""Fixed values of the container format: namespaces, type and attribute identifiers, codecs, status names."""

# They are part of stored containers and must be as they are.
SCHEME = "aff4"
PREFIX = f"{SCHEME}://"
FILE_PREFIX = "file://"
BUILTIN_PREFIX = "builtin://"
NS = "http://aff4.org/Schema#"
LEGACY_NS = "http://afflib.org/2009/aff4#"
VOLATILE_NS = "http://aff4.org/VolatileSchema#"
XSD = "http://www.w3.org/2001/XMLSchema#"
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"

TYPE = f"{RDF}type"
STORED = f"{NS}stored"
CONTAINS = f"{NS}contains"
DATA_STREAM = f"{NS}dataStream"
SIZE = f"{NS}size"
CHUNK_SIZE = f"{NS}chunkSize"
CHUNKS_IN_SEGMENT = f"{NS}chunksInSegment"
COMPRESSION = f"{NS}compressionMethod"
ORIGINAL_FILENAME = f"{NS}original_filename"

IMAGE = f"{NS}Image"
LEGACY_IMAGE = f"{LEGACY_NS}Image"
ABSTRACT_IMAGES = [f"{NS}{x}" for x in ("Image", "DiskImage", "VolumeImage", "MemoryImage", "ContiguousImage", "DiscontiguousImage")]
IMAGE_STREAMS = [f"{NS}ImageStream", f"{LEGACY_NS}stream"]
MAP = f"{NS}Map"
ZIP_SEGMENT = f"{NS}zip_segment"
ZIP_VOLUME = f"{NS}ZipVolume"
FILE = f"{NS}file"
DIRECTORY = f"{NS}directory"

#: Attribute names of older containers, and what they are read as.
LEGACY_ATTRIBUTES = {
    f"{LEGACY_NS}stored": STORED,
    f"{LEGACY_NS}dataStream": DATA_STREAM,
    f"{LEGACY_NS}size": SIZE,
    f"{LEGACY_NS}chunk_size": CHUNK_SIZE,
    f"{LEGACY_NS}chunks_in_segment": CHUNKS_IN_SEGMENT,
    f"{LEGACY_NS}CompressionMethod": COMPRESSION,
}
#: Types of older containers, and what they are read as.
LEGACY_TYPES = {
    f"{LEGACY_NS}Image": IMAGE,
    f"{LEGACY_NS}device": f"{NS}DiskImage",
    f"{LEGACY_NS}volume": f"{NS}VolumeImage",
    f"{LEGACY_NS}contiguousMap": f"{NS}ContiguousImage",
    f"{LEGACY_NS}map": MAP,
    f"{LEGACY_NS}stream": f"{NS}ImageStream",
}

#: Streams without storage: the pattern that each repeats.
SYMBOLIC = {f"{NS}Zero": b"\x00", f"{NS}FFDevice": b"\xff", f"{NS}UnknownData": b"UNKNOWN", f"{NS}UnreadableData": b"UNREADABLEDATA"}
SYMBOLIC_PREFIX = f"{NS}SymbolicStream"
UNREADABLE = f"{NS}UnreadableData"

CODECS = {
    "https://www.ietf.org/rfc/rfc1950.txt": "zlib",
    "https://tools.ietf.org/html/rfc1951": "deflate",
    "http://code.google.com/p/snappy/": "snappy",
    "https://github.com/google/snappy": "snappy",
    "https://code.google.com/p/lz4/": "lz4",
    f"{NS}NullCompressor": "stored",
    f"{LEGACY_NS}nullCompressor": "stored",
}
CODEC_URNS = {
    "zlib": "https://www.ietf.org/rfc/rfc1950.txt",
    "deflate": "https://tools.ietf.org/html/rfc1951",
    "snappy": "http://code.google.com/p/snappy/",
    "lz4": "https://code.google.com/p/lz4/",
    "stored": f"{NS}NullCompressor",
}

STATUS = {0: "STATUS_OK", -1: "NOT_FOUND", -2: "INCOMPATIBLE_TYPES", -3: "MEMORY_ERROR", -4: "GENERIC_ERROR", -5: "INVALID_INPUT", -6: "PARSING_ERROR", -7: "NOT_IMPLEMENTED", -8: "IO_ERROR", -9: "FATAL_ERROR", -10: "UNKNOWN", -11: "ABORTED"}

#: Characters of a component that are percent-encoded in a member's name; a doubled slash is encoded as well.
ESCAPED = '!$\\:*%?"<>|'

DEFAULT_CHUNK_SIZE, DEFAULT_CHUNKS_PER_BEVY = 32 * 1024, 1024
SMALL_FILE = 10 * 1024 * 1024

CONTAINER_DESCRIPTION, VERSION_TXT, INFORMATION_TURTLE = "container.description", "version.txt", "information.turtle"

#: EFI memory types that can be read, by name.
EFI_READABLE = ["EfiLoaderCode", "EfiLoaderData", "EfiBootServicesCode", "EfiBootServicesData", "EfiRuntimeServicesCode", "EfiRuntimeServicesData", "EfiConventionalMemory", "EfiACPIReclaimMemory", "EfiACPIMemoryNVS", "EfiPalCode"]
