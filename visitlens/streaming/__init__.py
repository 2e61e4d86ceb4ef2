"""Ad click analyses as streams."""
