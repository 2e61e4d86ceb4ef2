"""Writers: append, replace groups, versioned batches, JDBC."""
