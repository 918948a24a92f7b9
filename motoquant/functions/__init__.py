"""Column-to-Column building blocks; none of them starts a job."""
