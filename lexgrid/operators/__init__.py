"""Index construction, evaluation, codecs and ranking."""
