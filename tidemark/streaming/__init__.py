"""An extension: operators over streams. The batch operators that only filter, project or join statically
(keys, interval lookups) take streaming frames as they are."""
