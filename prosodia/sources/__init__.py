"""Readers and writers: annotation grids, analysis records, transcripts, waveforms."""
